"""Language detection by rank-order character n-gram profiles (Cavnar and Trenkle, 1994)."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, functions as F

PROFILE, GRAMS = 300, (1, 2, 3)

#: The most usual words of some languages; enough for a profile where none has been trained.
_COMMON = {
    "en": "the of and to in is that it was for on are as with his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know",
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden und will zwischen immer was sagte",
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son mais comme ou si leur y dont elle deux ces même aussi tout nous sa fait été aux cette entre après ont bien être sans peut avait encore autres depuis était ans fois où sous faire contre ses très toujours alors avant on moins temps",
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos también fue había era muy años hasta desde está mi porque qué sólo han yo hay vez puede todos así nos ni parte tiene él uno donde bien tiempo mismo ese ahora cada vida otro después te otros",
    "it": "di e il la che in a per un è non una si con da sono i del le dei al come più ma della ha nel anche lo o alla se ci gli questo hanno delle loro era essere stato ai quando tra due degli dalla molto cui poi fatto prima tutti suo sua solo dopo così già dove stata tutto anni fa",
    "pt": "de a o que e do da em um para é com não uma os no se na por mais as dos como mas foi ao ele das tem à seu sua ou ser quando muito há nos já está eu também só pelo pela até isso ela entre era depois sem mesmo aos ter seus quem nas me esse eles estão você tinha foram essa num nem suas meu às minha têm",
    "nl": "de van het een en in is dat op te zijn met voor niet aan er om ook als dan maar bij nog uit door naar heeft hij ze wordt tot je mijn deze over zo hebben ik was meer worden kan dit hun waar wat of zou al onder geen had wel we tegen na haar jaar gaan heel",
}


def grams(text: str, limit: int | None = PROFILE) -> list[str]:
    """The n-grams of a text, most frequent first, equally frequent ones by name."""
    counts: Counter[str] = Counter()
    for word, n in Counter(m[0] for m in re.finditer(r"[^\W\d_]+", text.lower())).items():
        padded = f"_{word}_"
        for size in GRAMS:
            for i in range(len(padded) - size + 1):
                counts[padded[i : i + size]] += n
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:limit]]


@lru_cache(maxsize=1)
def default_profiles() -> dict[str, dict[str, int]]:
    return {language: {g: i for i, g in enumerate(grams(words))} for language, words in _COMMON.items()}


#: Windows of a text that are counted at once; what a text needs besides its own length is bounded by it.
CHUNK = 1 << 20
_EDGE, _BITS = ord("_"), 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point whether it is a letter of a word."""
    table = np.zeros(0x110000, bool)
    every = np.arange(len(table), dtype="<u4").tobytes().decode("utf-32-le", "surrogatepass")
    for m in re.finditer(r"[^\W\d_]+", every):
        table[m.start() : m.end()] = True
    return table


def _code(gram: str) -> int:
    """A gram as a number; numbers are in the order of the grams."""
    return sum(ord(c) << _BITS * (2 - i) for i, c in enumerate(gram))


def _codes(text: str) -> np.ndarray:
    """The codes of grams(text)."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = np.zeros(len(points) + 2, bool)
    inside[1:-1] = _letters()[points]
    kept = inside[1:-1] | inside[:-2]  # letters, and of what is between two words the first
    edges = np.where(inside[1:-1], points, np.uint32(_EDGE))[kept]
    if not len(edges):
        return np.zeros(0, np.int64)
    line = np.concatenate((edges[:0] if edges[0] == _EDGE else [_EDGE], edges, edges[:0] if edges[-1] == _EDGE else [_EDGE])).astype(np.uint32)
    keys, counts = [], []
    for at in range(0, len(line), CHUNK):
        a = line[at : at + CHUNK + 2].astype(np.int64)
        first, n = a[:CHUNK] << 2 * _BITS, min(CHUNK, len(a))
        two = first[: len(a) - 1] | a[1 : n + 1] << _BITS
        three = (two[: len(a) - 2] | a[2 : n + 2])[a[1 : len(a) - 1][:n] != _EDGE]
        found = np.unique(np.concatenate((first, two, three)), return_counts=True)
        keys.append(found[0])
        counts.append(found[1])
    key, count = keys[0], counts[0]
    if len(keys) > 1:
        key, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(inverse, np.concatenate(counts)).astype(np.int64)
    # every word has an edge on both sides, and on the line two words share one
    edge = key == _EDGE << 2 * _BITS
    count = np.where(edge, 2 * (count - 1), count)
    if len(key) > PROFILE:
        least = np.partition(count, len(count) - PROFILE)[len(count) - PROFILE]
        key, count = key[count >= least], count[count >= least]
    return key[np.argsort(-count, kind="stable")][:PROFILE]


Table = tuple[tuple[str, ...], np.ndarray, np.ndarray]


def table(profiles: dict[str, dict[str, int]], languages: Iterable[str] | None = None) -> Table:
    """Profiles as numbers: the languages, the codes of all their grams in order, and for each gram its place in each
    language, far off where that hasn't it."""
    chosen = tuple(x for x in (languages or profiles) if x in profiles)
    codes = {_code(g): g for x in chosen for g in profiles[x] if len(g) <= max(GRAMS)}
    known = np.array(sorted(codes), np.int64)
    places = np.array([[profiles[x].get(codes[c], 1 << 40) for x in chosen] for c in known.tolist()], np.int64).reshape(len(known), len(chosen))
    return chosen, known, places


@lru_cache(maxsize=1)
def default_table() -> Table:
    return table(default_profiles())


def rank(text: str, profiles: dict[str, dict[str, int]] | None = None, languages: Iterable[str] | None = None, of: Table | None = None) -> list[tuple[str, float]]:
    """Languages with probabilities, best first; none for a text without letters. of: the table of the profiles, where
    one is at hand."""
    chosen, known, places = of or (table(profiles or default_profiles(), languages) if profiles or languages else default_table())
    own = _codes(text)
    if not len(own) or not chosen:
        return []
    worst = max(1, PROFILE * len(own))
    at = np.searchsorted(known, own)
    hit = np.flatnonzero((at < len(known)) & (known[np.minimum(at, len(known) - 1)] == own)) if len(known) else at[:0]
    far = PROFILE * (len(own) - len(hit)) + np.minimum(np.abs(hit[:, None] - places[at[hit]]), PROFILE).sum(axis=0)
    near = {x: 1 - n / worst for x, n in zip(chosen, far.tolist(), strict=True)}
    total = sum(x**8 for x in near.values()) or 1.0
    return sorted(((k, x**8 / total) for k, x in near.items()), key=lambda x: (-x[1], x[0]))


def train(labelled: DataFrame, text: str, language: str) -> dict[str, dict[str, int]]:
    """Profiles from a table of texts with their languages: gram counts are made by Spark, the top ranks collected."""
    words = labelled.select(F.col(language).alias("l"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}]+"), F.lit(0))).alias("w")).filter("l is not null")
    padded = words.groupBy("l", "w").count().select("l", "count", F.concat(F.lit("_"), "w", F.lit("_")).alias("p"))
    each = [F.transform(F.sequence(F.lit(1), F.length("p") - (n - 1)), lambda i, n=n: F.substring(F.col("p"), i, F.lit(n))) for n in GRAMS]
    counts = padded.select("l", "count", F.explode(F.concat(*each)).alias("g")).groupBy("l", "g").agg(F.sum("count").alias("n"))
    top = counts.groupBy("l").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "g"))), 1, PROFILE).alias("top"))
    return {r["l"]: {x["g"]: i for i, x in enumerate(r["top"])} for r in top.collect()}
