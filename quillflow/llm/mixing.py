"""Operator 2: mixing sources to target weights by hierarchical budgets.

Documents hang in a tree of domain, language and source; tokens are runs of characters other than space, tab and line
ends. A token budget is handed down the tree by weight. A child can take its tokens times MAX_EPOCHS at most; what it
can't take goes to its siblings by their weights, and only what all of them can't take leaves the parent for the
parent's own siblings, since a parent can take just the sum of its children. Each split is exact: children in the order
of capacity per weight are filled while their fair share of what is left covers them, the others share the rest.

A leaf reads whole epochs of its documents while its budget lasts, then a prefix of one more, in the order of
md5(seed:epoch:doc_id): as many documents as fit. The prefix ends at a hash, so choosing needs no sort of the texts:
sums over ranges of the hash find the range where the budget ends, only that range is ordered, and the documents table
is filtered in place against one row for each leaf.

Defined results: null texts have no tokens; documents without tokens are chosen with the epoch prefix they fall in.
Null languages and sources are the empty string. Rows with a null doc_id have no place in an epoch and aren't chosen.
Rows with the same doc_id in a leaf are chosen together. Leaves of weight 0 or without tokens get nothing. Columns of
any other name pass through select_documents() untouched. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .shared import spread, unused, written

SPACE = "[^ \\t\\n\\r]+"


@dataclass(frozen=True)
class Plan:
    """Weights are whole numbers; names that a mapping lacks weigh other. The budget is tokens * numerator // denominator.
    domain: the column that holds a document's domain (null is the empty string); without one it is that of domain_of()."""

    domains: dict[str, int] = field(default_factory=lambda: {"d0": 4, "d1": 3, "d2": 2, "d3": 1})
    languages: dict[str, int] = field(default_factory=lambda: {"en": 5, "de": 2, "fr": 2, "es": 1})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 1
    numerator: int = 1
    denominator: int = 2
    max_epochs: int = 3
    seed: int = 17
    domain: str | None = None


PLAN = Plan()
LEVELS = (("domain", "domains"), ("lang", "languages"), ("source", "sources"))


def domain_of(source: Column) -> Column:
    """The default domains: four, by the number that ends a source's name."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) as bigint)"), F.lit(0))
    return F.concat(F.lit("d"), (number % 4).cast("string"))


def placed_in(plan: Plan) -> dict[str, Column]:
    """A document's place in the tree."""
    domain = domain_of(F.col("source")) if plan.domain is None else F.coalesce(F.col(f"`{plan.domain}`").cast("string"), F.lit(""))
    return {"domain": domain, "lang": F.coalesce("lang", F.lit("")), "source": F.coalesce("source", F.lit(""))}


def keyed(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(doc_id, domain, lang, source, tokens) of the rows that can be chosen."""
    tokens = F.coalesce(F.regexp_count("text", F.lit(SPACE)), F.lit(0)).cast("long")
    rows = spread(docs).select(F.col("doc_id").cast("long").alias("doc_id"), *(c.alias(n) for n, c in placed_in(plan).items()), tokens.alias("tokens"))
    return rows.filter("doc_id is not null")


def weight(name: str, mapping: dict[str, int], other: int) -> Column:
    w = F.lit(other)
    for key, value in mapping.items():
        w = F.when(F.col(name) == key, value).otherwise(w)
    return w.cast("long")


def fill(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Adds budget to (..., capacity, weight, given): given is the parent's budget."""
    order = Window.partitionBy(*parents).orderBy(F.col("capacity") / F.col("weight"), name)
    before, whole = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*parents)
    big = lambda x: x.cast("decimal(38,0)")
    taken = F.coalesce(F.sum("capacity").over(before), F.lit(0))
    left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    full = big(F.col("capacity")) * left <= big(F.col("given") - taken) * F.col("weight")
    nodes = nodes.withColumn("full", full)
    rest = F.col("given") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole)
    shared = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole)
    nodes = nodes.withColumn("rest", big(rest)).withColumn("shared", shared)
    part = F.expr("(rest * weight) div shared")
    return nodes.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part).cast("long")).drop("full", "rest", "shared")


def budgets(leaves: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(domain, lang, source, tokens, budget) for (domain, lang, source, tokens), one row each."""
    names = [n for n, _ in LEVELS]
    nodes = leaves.filter("tokens > 0").withColumn("capacity", F.col("tokens") * plan.max_epochs)
    for name, mapping in LEVELS:
        nodes = nodes.withColumn(f"w_{name}", weight(name, getattr(plan, mapping), plan.other)).filter(F.col(f"w_{name}") > 0)
    total = leaves.agg(F.floor(F.sum("tokens").cast("decimal(38,0)") * plan.numerator / plan.denominator).cast("long").alias("given"))
    given = total.withColumn("_all", F.lit(1))
    parents: list[str] = ["_all"]
    nodes = nodes.withColumn("_all", F.lit(1))
    for i, name in enumerate(names):
        level = nodes.groupBy(*parents, name).agg(F.sum("capacity").alias("capacity"), F.first(f"w_{name}").alias("weight"))
        filled = fill(level.join(given, parents), parents, name)
        parents = [*parents, name]
        given = filled.select(*parents, F.col("budget").alias("given"))
        if i == len(names) - 1:
            return leaves.join(given.select(*names, F.col("given").alias("budget")), names, "left").fillna(0, ["budget"])
    raise AssertionError


def rank(epoch: Column, doc_id: Column, plan: Plan) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(plan.seed)), epoch.cast("string"), doc_id.cast("string")))


def cuts(docs: DataFrame, plan: Plan = PLAN) -> DataFrame:
    """(domain, lang, source, budget, whole, cut): epochs read whole, and the last hash chosen of the one after them."""
    names = [n for n, _ in LEVELS]
    rows = written(keyed(docs, plan), "mixing-rows")
    leaves = rows.groupBy(*names).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    shares = budgets(leaves, plan)
    shares = shares.withColumn("whole", F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long"))
    shares = written(shares.withColumn("rest", F.col("budget") - F.col("whole") * F.col("tokens")), "mixing-leaves")
    # ranges of the hash, each of about ten thousand documents
    ranges = F.greatest(F.lit(1), F.least(F.lit(65536), F.expr("n div 10000")))
    placed = rows.join(shares.select(*names, "whole", "rest", ranges.alias("ranges")), names).filter("rest > 0").withColumn("h", rank(F.col("whole"), F.col("doc_id"), plan))
    placed = placed.withColumn("range", F.expr("shiftright(cast(conv(substring(h, 1, 10), 16, 10) as bigint) * ranges, 40)"))
    sums = placed.groupBy(*names, "range", "rest").agg(F.sum("tokens").alias("t"), F.max("h").alias("last"))
    upto = Window.partitionBy(*names).orderBy("range")
    sums = written(sums.withColumn("upto", F.sum("t").over(upto)), "mixing-ranges")
    below = sums.filter("upto <= rest").groupBy(*names).agg(F.max("last").alias("cut"))
    edge = sums.filter("upto > rest and upto - t <= rest").select(*names, "range", (F.col("rest") - F.col("upto") + F.col("t")).alias("more"))
    running = F.sum("tokens").over(Window.partitionBy(*names).orderBy("h").rangeBetween(Window.unboundedPreceding, 0))
    within = placed.join(edge, [*names, "range"]).withColumn("sum", running).filter("sum <= more").groupBy(*names).agg(F.max("h").alias("cut"))
    cut = below.union(within).groupBy(*names).agg(F.max("cut").alias("cut"))
    return shares.join(cut, names, "left").select(*names, "tokens", "budget", "whole", F.coalesce("cut", F.lit("")).alias("cut"))


def select_documents(docs: DataFrame, plan: Plan = PLAN, epoch: str = "_epoch") -> DataFrame:
    """docs with a column for the epoch; a document that several epochs choose has a row for each."""
    names = [n for n, _ in LEVELS]
    own_names = {n: unused(docs, f"_leaf_{n}") for n in (*names, "whole", "cut")}
    leaf = written(cuts(docs, plan), "mixing-cuts").select(*(F.col(n).alias(own) for n, own in own_names.items()))
    whole, cut = F.col(own_names["whole"]), F.col(own_names["cut"])
    own = placed_in(plan)
    on = None
    for n in names:
        same = own[n] == F.col(own_names[n])
        on = same if on is None else on & same
    both = docs.filter("doc_id is not null").join(leaf, on)
    both = both.withColumn(epoch, F.explode(F.sequence(F.lit(0).cast("long"), whole)))
    chosen = both.filter((F.col(epoch) < whole) | (rank(F.col(epoch), F.col("doc_id").cast("long"), plan) <= cut))
    return chosen.select(*(F.col(f"`{c}`") for c in docs.columns), epoch)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    chosen = select_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return chosen.select("doc_id", F.col("_epoch").alias("epoch"), domain_of(F.col("source")).alias("domain"), "lang", "source")


def oracle(plan: Plan = PLAN) -> str:
    """The same in DuckDB's SQL, with a plain running sum over each leaf."""

    def weigh(name: str, mapping: dict[str, int]) -> str:
        return f"CASE {name} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in mapping.items()) + f" ELSE {plan.other} END" if mapping else str(plan.other)

    parts = [
        f"""keyed AS (SELECT doc_id, 'd' || CAST(coalesce(TRY_CAST(regexp_extract(coalesce(source, ''), '([0-9]+)$', 1) AS BIGINT), 0) % 4 AS VARCHAR) AS domain,
  coalesce(lang, '') AS lang, coalesce(source, '') AS source, CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS BIGINT) AS tokens FROM documents WHERE doc_id IS NOT NULL)""",
        "leaves AS (SELECT domain, lang, source, CAST(sum(tokens) AS BIGINT) AS tokens FROM keyed GROUP BY ALL)",
        f"given0 AS (SELECT 1 AS a, sum(tokens)::HUGEINT * {plan.numerator} // {plan.denominator} AS given FROM leaves)",
        f"nodes AS (SELECT 1 AS a, *, tokens * {plan.max_epochs} AS capacity FROM leaves WHERE tokens > 0)",
    ]
    parents = ["a"]
    for i, (name, mapping) in enumerate(LEVELS):
        keys, by = [*parents, name], ", ".join(parents)
        parts += [
            f"level{i} AS (SELECT {', '.join(keys)}, sum(capacity)::HUGEINT AS capacity, {weigh(name, getattr(plan, mapping))}::HUGEINT AS weight FROM nodes GROUP BY {', '.join(keys)})",
            f"""test{i} AS (SELECT *, capacity * (sum(weight) OVER (PARTITION BY {by}) - coalesce(sum(weight) OVER before, 0)) <= (given - coalesce(sum(capacity) OVER before, 0)) * weight AS is_full
  FROM level{i} JOIN given{i} USING ({by}) WHERE weight > 0 WINDOW before AS (PARTITION BY {by} ORDER BY capacity::DOUBLE / weight::DOUBLE, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
            f"""given{i + 1} AS (SELECT {', '.join(keys)}, CASE WHEN is_full THEN capacity ELSE
  (given - coalesce(sum(capacity) FILTER (is_full) OVER (PARTITION BY {by}), 0))::HUGEINT * weight // (sum(weight) FILTER (NOT is_full) OVER (PARTITION BY {by}))::HUGEINT END AS given FROM test{i})""",
        ]
        parents = keys
    parts += [
        "shares AS (SELECT l.*, g.given // l.tokens AS whole, g.given - g.given // l.tokens * l.tokens AS rest FROM leaves l JOIN given3 g USING (domain, lang, source) WHERE tokens > 0)",
        f"""epochs AS (SELECT k.*, s.whole, s.rest, e.epoch, md5('{plan.seed}:' || CAST(e.epoch AS VARCHAR) || ':' || CAST(doc_id AS VARCHAR)) AS h
  FROM keyed k JOIN shares s USING (domain, lang, source) JOIN (SELECT unnest(range(0, {plan.max_epochs + 1})) AS epoch) e ON e.epoch <= s.whole)""",
        "summed AS (SELECT *, sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY h) AS upto FROM epochs)",
    ]
    return "WITH " + ",\n".join(parts) + "\nSELECT doc_id, CAST(epoch AS BIGINT) AS epoch, domain, lang, source FROM summed WHERE epoch < whole OR rest > 0 AND upto <= rest"


ORACLE = oracle()
