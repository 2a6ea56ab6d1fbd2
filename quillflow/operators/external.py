"""External commands as taggers, transformers and parsers: once per document, in the tasks, with a time limit."""

from __future__ import annotations

import json
import os
import re
import shlex
import subprocess
import tempfile
from dataclasses import dataclass, field
from typing import Any, ClassVar
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .. import model
from ..functions.fields import OnSet, put_map
from .base import Handler, register, text
from .taggers import RegexRule

Meta = dict[str, list[str]]


def dump(meta: Meta, kind: str) -> str:
    if kind == "json":
        return json.dumps(meta, ensure_ascii=False)
    if kind == "xml":
        root = ElementTree.Element("metadata")
        for name, found in meta.items():
            for v in found:
                ElementTree.SubElement(root, "field", name=name).text = v
        return ElementTree.tostring(root, encoding="unicode")
    safe = lambda x: re.sub(r"([\\:=\s#!])", lambda m: {"\n": "\\n", "\r": "\\r", "\t": "\\t"}.get(m[1], "\\" + m[1]), x)
    return "".join(f"{safe(name)}={safe(v)}\n" for name, found in meta.items() for v in found)


def load(source: str, kind: str) -> Meta:
    out: Meta = {}
    if kind == "json":
        for name, v in (json.loads(source) if source.strip() else {}).items():
            out[name] = [str(x) for x in v] if isinstance(v, list) else [str(v)]
    elif kind == "xml":
        for e in ElementTree.fromstring(source) if source.strip() else ():
            out.setdefault(e.get("name") or e.tag, []).append(e.text or "")
    else:
        plain = lambda x: re.sub(r"\\(.)", lambda m: {"n": "\n", "r": "\r", "t": "\t"}.get(m[1], m[1]), x)
        for line in source.splitlines():
            m = re.match(r"\s*((?:\\.|[^\\:=\s])+)\s*[:=]?\s*(.*)", line)
            if m and not line.lstrip().startswith(("#", "!")):
                out.setdefault(plain(m[1]), []).append(plain(m[2]))
    return out


@dataclass(kw_only=True)
class External(Handler):
    """command: words with the tokens ${INPUT} ${OUTPUT} ${INPUT_META} ${OUTPUT_META} ${REFERENCE}. Without ${INPUT}
    or ${OUTPUT} standard input and output are used. No shell is involved, so a token is one argument whatever it holds.
    patterns take fields from the lines of both outputs. A failing command leaves the row with its error."""

    command: str
    metadata_input_format: str = "json"
    metadata_output_format: str = "json"
    on_set: OnSet = "append"
    patterns: list[RegexRule] = field(default_factory=list)
    environment: dict[str, str] = field(default_factory=dict)
    temp_dir: str | None = None
    timeout_seconds: float = 60
    input_disabled: bool = False
    takes_content: ClassVar[bool] = True
    takes_fields: ClassVar[bool] = True

    def execute(self, reference: str, content: bytes, meta: Meta) -> tuple[str, Meta, str | None]:
        with tempfile.TemporaryDirectory(dir=self.temp_dir) as folder:
            path = {x: os.path.join(folder, x.lower()) for x in ("INPUT", "OUTPUT", "INPUT_META", "OUTPUT_META")}
            used = {x for x in path if "${" + x + "}" in self.command}
            if "INPUT" in used:
                with open(path["INPUT"], "wb") as f:
                    f.write(content)
            if "INPUT_META" in used:
                with open(path["INPUT_META"], "w", encoding="utf-8") as f:
                    f.write(dump(meta, self.metadata_input_format))
            words = []
            for word in shlex.split(self.command):
                for name, value in (path | {"REFERENCE": reference}).items():
                    word = word.replace("${" + name + "}", value)
                words.append(word)
            given = b"" if self.input_disabled or "INPUT" in used else content
            try:
                done = subprocess.run(words, input=given, capture_output=True, timeout=self.timeout_seconds, env=os.environ | self.environment, check=False)
            except (OSError, subprocess.TimeoutExpired) as e:
                return "", {}, f"{type(e).__name__}: {e}"

            def read(name: str) -> str:
                try:
                    with open(path[name], encoding="utf-8", errors="replace") as f:
                        return f.read()
                except FileNotFoundError:
                    return ""

            out, err = done.stdout.decode("utf-8", "replace"), done.stderr.decode("utf-8", "replace")
            fields = load(read("OUTPUT_META"), self.metadata_output_format) if "OUTPUT_META" in used else {}
            for line in [*out.splitlines(), *err.splitlines()]:
                for r in self.patterns:
                    for m in re.finditer(r.regex, line, re.I if r.ignore_case else 0):
                        name = m[r.field_group] if r.field_group > 0 else r.to_field
                        fields.setdefault(name, []).append(m[max(0, r.value_group)])
            return (read("OUTPUT") if "OUTPUT" in used else out), fields, None

    def apply(self, df: DataFrame) -> DataFrame:
        execute = self.execute

        @F.pandas_udf(f"content string, fields {model.META}, error string")
        def run(on: pd.Series, ref: pd.Series, raw: pd.Series, meta: pd.Series) -> pd.DataFrame:
            def one(ok: bool, r: str, x: bytes | None, m: Any) -> tuple:
                known = {k: list(v) for k, v in (m.items() if isinstance(m, dict) else m)} if m is not None else {}
                return execute(r, x or b"", known) if ok else (None, {}, None)

            return pd.DataFrame([one(*x) for x in zip(on, ref, raw, meta, strict=True)], columns=["content", "fields", "error"])

        on = self.guard()
        df = df.withColumn("_on", on).withColumn("_ext", run(F.col("_on"), F.col("reference"), F.coalesce("raw", F.encode(text(), "UTF-8")), F.col("metadata")))
        ok = F.col("_on") & F.col("_ext.error").isNull()
        change = {"error": F.coalesce("error", "_ext.error")}
        if self.takes_content:
            change |= {"content": F.when(ok, F.col("_ext.content")).otherwise(F.col("content")), "raw": F.when(~ok, F.col("raw"))}
        if self.takes_fields:
            change["metadata"] = F.when(ok, put_map(F.col("metadata"), F.col("_ext.fields"), self.on_set)).otherwise(F.col("metadata"))
        return df.withColumns(change).drop("_on", "_ext")


@register
@dataclass(kw_only=True)
class ExternalTransformer(External):
    kind: ClassVar[str] = "transformer"


@register
@dataclass(kw_only=True)
class ExternalTagger(External):
    kind: ClassVar[str] = "tagger"
    takes_content: ClassVar[bool] = False


@register
@dataclass(kw_only=True)
class ExternalParser(External):
    kind: ClassVar[str] = "parser"
