"""Mixing sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic), and a cell weighs the tokens in it. Raking scales the cells' weights by one
margin after another until sources, languages and topics all have their target shares of the tokens. A document's
calibrated probability is its cell's factor, scaled so that the expected sample has ``budget`` of all tokens; factors that
would need a probability over 1 stay at 1 and the rest is scaled on (a document can't be drawn twice). A hash of the
identifier decides, so that a sample is the same wherever it is drawn.

Cells are collected only while there are at most ``most_cells`` of them; more are raked as a DataFrame by the same steps.

Without given targets, a value's share of the tokens to the power ``flatten``, made to add up to 1, is its target: large
sources give way to small ones. A value without any target counts in full, as the observed share.

Defined cases: a null text is empty and has no tokens; a null source or language is a value of its own; a document
without tokens has its cell's probability (1 in a cell without any tokens); repeated rows are decided alike; an empty table
gives no rows; other columns are ignored, whatever their names; very long texts are read whole; rows that share an identifier
share their draw, so that those of one cell are decided alike.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, saved

MARGINS = ("source", "lang", "topic")
MOST_CELLS = 200_000
ROUNDS = 60
TOLERANCE = 1e-9
SEED = 4_711
TOPICS = 8
#: What is raked to unless told otherwise: languages by these shares, topics evenly, sources by flattened shares.
TARGETS = {"lang": {"en": 0.55, "de": 0.15, "fr": 0.15, "es": 0.15}, "topic": {str(k): 1 / TOPICS for k in range(TOPICS)}}


def topic_of(text: Column, topics: int = TOPICS) -> Column:
    """A stand-in where no topic column is given: the hash class that most of the text's distinct words fall into, the first of equal ones."""
    words = F.filter(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), lambda w: w != "")
    hashes = F.array_distinct(F.transform(words, lambda w: F.crc32(w)))
    none = F.array_repeat(F.lit(0), topics)
    counts = lambda n, h: F.transform(n, lambda x, i: x + F.when(i == F.pmod(h, F.lit(topics)), 1).otherwise(0))
    return F.aggregate(hashes, none, counts, lambda n: F.array_position(n, F.array_max(n)) - 1).cast("string")


def n_tokens(text: Column) -> Column:
    """Words between ASCII blanks."""
    return F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rake(cells: dict[tuple, float], targets: list[dict], rounds: int = ROUNDS, tolerance: float = TOLERANCE) -> dict[tuple, float]:
    """Factors of cells such that factor * weight has the target sums over each margin (an iterate, where no table has them)."""
    keys = list(cells)
    start = np.array([cells[k] for k in keys], float)
    weight = start.copy()
    axes = []
    for a, target in enumerate(targets):
        names = sorted({k[a] for k in keys}, key=str)
        at = {x: i for i, x in enumerate(names)}
        axes.append((np.array([at[k[a]] for k in keys], int), np.array([target.get(x, 0.0) for x in names])))
    for _ in range(rounds):
        worst = 0.0
        for index, want in axes:
            have = np.bincount(index, weight, len(want))
            ratio = np.divide(want, have, out=np.ones(len(want)), where=have > 0)
            worst = max(worst, float(np.abs(have - want).max(initial=0.0)))
            weight *= ratio[index]
        if worst <= tolerance * max(start.sum(), 1.0):
            break
    return dict(zip(keys, np.divide(weight, start, out=np.ones(len(start)), where=start > 0).tolist()))


def _targets(sums: list[dict], given: dict | None, flatten: float) -> list[dict]:
    """Target tokens of each value of each margin, adding up to all tokens."""
    out = []
    for name, have in zip(MARGINS, sums):
        total = sum(have.values())
        asked = {k: float(v) for k, v in ((given or {}).get(name) or {}).items() if have.get(k)}
        rest = {k: v for k, v in have.items() if k not in asked}
        share = {k: (v / total) ** flatten for k, v in rest.items() if v} if not asked else {k: v / total for k, v in rest.items() if v}
        share |= asked
        scale = total / sum(share.values()) if share else 0.0
        out.append({k: v * scale for k, v in share.items()})
    return out


def probabilities(cells: dict[tuple, float], factors: dict[tuple, float], budget: float) -> dict[tuple, float]:
    """min(1, c * factor) with c such that the expected tokens are ``budget`` of all."""
    keys = sorted((k for k in cells if cells[k] > 0), key=lambda k: (-factors[k], str(k)))
    want, fixed, rest = budget * sum(cells.values()), 0.0, sum(cells[k] * factors[k] for k in keys)
    c = 1.0
    for k in keys:
        c = (want - fixed) / rest if rest > 0 else 0.0
        if c * factors[k] <= 1:
            break
        fixed += cells[k]
        rest -= cells[k] * factors[k]
    else:
        c = np.inf
    return {k: float(min(1.0, c * factors[k])) if cells[k] > 0 else 1.0 for k in cells}


def _rake_apart(cells: DataFrame, given: dict | None, flatten: float, budget: float, rounds: int) -> DataFrame:
    """The steps of ``rake`` and ``probabilities`` on a DataFrame of cells, for more of them than one process should hold."""
    total = cells.agg(F.sum("tokens")).first()[0] or 0
    now = cells.withColumn("weight", F.col("tokens").cast("double"))
    wants = []
    for m in MARGINS:
        have = cells.groupBy(m).agg(F.sum("tokens").alias("have")).where("have > 0")
        asked = (given or {}).get(m) or {}
        told = cells.sparkSession.createDataFrame([(k, float(v)) for k, v in asked.items()], f"{m} string, asked double")
        share = have.join(told, have[m].eqNullSafe(told[m]), "left").select(have[m], F.coalesce("asked", (F.col("have") / F.lit(total)) if asked else F.pow(F.col("have") / F.lit(total), F.lit(flatten))).alias("share"))
        wants.append(saved(share.crossJoin(F.broadcast(share.agg(F.sum("share").alias("all")))).select(m, (F.col("share") / F.col("all") * F.lit(float(total))).alias("want"))))
    for _ in range(rounds):
        for m, want in zip(MARGINS, wants):
            have = now.groupBy(m).agg(F.sum("weight").alias("have"))
            ratio = have.join(want, have[m].eqNullSafe(want[m]), "left").select(have[m].alias("value"), F.when(F.col("have") > 0, F.coalesce("want", F.lit(0.0)) / F.col("have")).otherwise(1.0).alias("ratio"))
            now = now.join(ratio, now[m].eqNullSafe(ratio["value"]), "left").withColumn("weight", F.col("weight") * F.col("ratio")).drop("value", "ratio")
        now = saved(now)
    now = now.withColumn("factor", F.when(F.col("tokens") > 0, F.col("weight") / F.col("tokens")).otherwise(1.0))
    whole = now.agg(F.sum(F.col("tokens") * F.col("factor"))).first()[0]
    c, fixed = budget * total / whole if whole else 1.0, 0
    while True:  # each pass fixes the cells that would be over 1
        over = F.col("factor") * F.lit(float(c)) > 1
        row = now.agg(F.sum(F.when(over, F.col("tokens"))).alias("full"), F.sum(F.when(~over, F.col("tokens") * F.col("factor"))).alias("rest"), F.count(F.when(over & (F.col("tokens") > 0), 1)).alias("n")).first()
        if row.n == fixed or not row.rest:
            break
        fixed, c = row.n, max(c, (budget * total - (row.full or 0)) / row.rest)
    return now.select(*MARGINS, F.col("factor"), F.when(F.col("tokens") > 0, F.least(F.lit(1.0), F.col("factor") * F.lit(float(c)))).otherwise(1.0).alias("probability"))


def mix(docs: DataFrame, targets: dict | None = TARGETS, flatten: float = 0.5, budget: float = 0.6, seed: int = SEED, most_cells: int = MOST_CELLS, rounds: int = ROUNDS, topic: Column | None = None,
        id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens, mark, factor, probability, kept), a row for each row of ``docs``; mark: xxhash64 of the text.

    targets: {"source" | "lang" | "topic": {value: share}}, None for flattened shares alone; budget: the expected sample's share of all tokens.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = saved(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"), (topic if topic is not None else topic_of(text)).alias("topic"), n_tokens(text).alias("n_tokens"), F.xxhash64(text).alias("mark")))
    cells = saved(base.groupBy(*MARGINS).agg(F.sum("n_tokens").alias("tokens")))
    spark = docs.sparkSession
    if cells.count() <= most_cells:
        held = {(r.source, r.lang, r.topic): float(r.tokens) for r in cells.collect()}
        sums = [{} for _ in MARGINS]
        for k, v in held.items():
            for a in range(len(MARGINS)):
                sums[a][k[a]] = sums[a].get(k[a], 0.0) + v
        factors = rake(held, _targets(sums, targets, flatten), rounds)
        chance = probabilities(held, factors, budget)
        rates = F.broadcast(spark.createDataFrame([(*k, factors[k], chance[k]) for k in held], "source string, lang string, topic string, factor double, probability double"))  # `most_cells` rows
    else:
        rates = _rake_apart(cells, targets, flatten, budget, rounds)
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11).cast("double") + 0.5) / float(1 << 53)
    same = [base[m].eqNullSafe(rates[m]) for m in MARGINS]
    out = base.join(rates, same[0] & same[1] & same[2]).select(*[base[c] for c in ("doc_id", *MARGINS, "n_tokens", "mark")], "factor", "probability")
    return out.withColumn("kept", u < F.col("probability"))


def query(spark, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
