"""Mixing sources to target weights by balanced sampling (cube method).

Every source gets a target number of tokens. A source's rate is its target over its
own size; each document is taken floor(rate) times for certain and once more with the
rate's fraction as inclusion probability. The flight phase moves these probabilities,
three documents at a time, along the null space of the two balancing constraints
(tokens, documents) until one of the three is 0 or 1, so both totals stay as they were.
Documents come in descending order of size. One that would stay undecided until much
smaller ones arrive is settled at once against all smaller ones of its block, each of which
moves by its share: along both constraints where their room suffices, else along the token
constraint alone. So what is left are the smallest documents. Blocks of documents fly in
parallel, and the few that each leaves fly again with those of other blocks, until one block
per source is left, where the landing phase drops the document constraint and draws the last
document.
"""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftspark.llm.common import cut, word_count

#: Rows of one block of the flight phase, which is held in memory.
BLOCK = 4096
#: Sources up to which their plan (well under 1 kB a row) is sent to all executors; with more, documents meet it in a salted join.
PLAN_SENT, SALTS = 10_000, 64
#: A document this many times larger than the next one is settled: see above.
BEHIND = 1.25
EPS = 1e-9


def _ranked(sizes: DataFrame) -> DataFrame:
    """sizes with a column at: the number of sources before its own by code point, null last. Only counts of partitions reach the driver."""
    order = F.col("source").asc_nulls_last()
    dealt = cut(sizes.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    before, offsets = 0, [F.lit(-1), F.lit(0)]
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        offsets += [F.lit(r["part"]), F.lit(before)]
        before += r["count"]
    inside = F.row_number().over(Window.partitionBy("part").orderBy(order)) - 1
    return dealt.withColumn("at", (F.element_at(F.create_map(*offsets), F.col("part")) + inside).cast("long")).drop("part")


def targets(sizes: DataFrame, weights: Sequence[float] | DataFrame, cap: float, total: float | None = None) -> DataFrame:
    """sizes (source, total, ...) with columns at, weight and target: shares of total by weight, none above cap times its source's size.

    What exceeds is shared anew by weight among the others, until none is above. weights
    repeat over the sources in code point order, null last, or are a table (source, weight),
    in which a source that is missing weighs nothing. The level that all targets below their
    cap stand at is found by sums over the sources: one row a turn comes to the driver.
    """
    if isinstance(weights, DataFrame):
        named = weights.select(F.col("source").alias("_s"), F.col("weight").cast("double").alias("_w"))
        ranked = _ranked(sizes).join(named, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("weight", F.coalesce("_w", F.lit(0.0))).drop("_s", "_w")
    else:
        ranked = _ranked(sizes).withColumn("weight", F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("at") % len(weights) + 1).cast("int")))
    ranked = cut(ranked)
    most, wanted = F.lit(cap) * F.col("total"), F.col("weight") > 0
    level, capped = 0.0, -1
    while True:
        over = wanted & (F.lit(level) * F.col("weight") > most)
        found = ranked.agg(F.sum("total").alias("all"), F.count(F.when(over, 1)).alias("capped"), F.sum(F.when(over, most)).alias("held"), F.sum(F.when(wanted & ~over, F.col("weight"))).alias("free")).first()
        if found["capped"] == capped or not found["free"]:
            break
        level, capped = ((float(found["all"] or 0) if total is None else float(total)) - (found["held"] or 0.0)) / found["free"], found["capped"]
    return ranked.withColumn("target", F.when(wanted, F.least(F.lit(level) * F.col("weight"), most)).otherwise(0.0))


def _planned(rows: DataFrame, plan: DataFrame, sources: int, salt: Column, match) -> DataFrame:
    """rows joined with their source's row of plan, whatever a source's share of the rows."""
    if sources <= PLAN_SENT:
        return rows.join(F.broadcast(plan), match(rows, plan))
    salted = plan.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_mine", F.pmod(F.xxhash64(salt), F.lit(SALTS)).cast("int"))
    return rows.join(salted, match(rows, salted) & (rows["_mine"] == salted["_salt"])).drop("_mine", "_salt")


class Flight:
    """The units of one block, in descending order of size: fly() decides all but a few, land() these."""

    def __init__(self, sizes: Sequence[float], p: Sequence[float], seed: str):
        self.rng, self.sizes, self.p = random.Random(seed), np.asarray(sizes, float).tolist(), np.asarray(p, float).tolist()
        self.left: list[int] = []

    def _open(self, k: int) -> bool:
        return EPS < self.p[k] < 1 - EPS

    def _move(self, units: list[int], direction: Sequence[float]) -> None:
        """Moves the probabilities until one is 0 or 1, either way with the chance that keeps each one's mean."""
        pairs = [(self.p[k], d) for k, d in zip(units, direction, strict=True) if d]
        up = min((1 - p) / d if d > 0 else p / -d for p, d in pairs)
        down = min(p / d if d > 0 else (1 - p) / -d for p, d in pairs)
        step = up if self.rng.random() * (up + down) < down else -down
        for k, d in zip(units, direction, strict=True):
            self.p[k] += step * d

    def _settle(self, head: int, others: list[int]) -> None:
        """Moves head against all others until it is 0 or 1 or none of them is left."""
        size = self.sizes[head]
        at = np.asarray(others)
        while self._open(head):
            p, s = np.asarray([self.p[k] for k in at]), np.asarray([self.sizes[k] for k in at])
            good = (p > EPS) & (p < 1 - EPS) & (s > 0)
            at, p, s = at[good], p[good], s[good]
            if not len(at):
                return
            room = np.minimum(p, 1 - p)
            a, b, c = room.sum(), room @ s, room @ (s * s)
            share = room * (size / b)  # along tokens alone
            if a * c > b * b * (1 + EPS):
                both = room * ((c - b * size) + (a * size - b) * s) / (a * c - b * b)
                if (p - both * (1 - self.p[head]) > 0).all() and (p - both * (1 - self.p[head]) < 1).all() and (p + both * self.p[head] > 0).all() and (p + both * self.p[head] < 1).all():
                    share = both
            self._move([head, *at.tolist()], [1.0, *(-share).tolist()])

    def fly(self) -> None:
        held: list[int] = []
        for k in range(len(self.p)):
            if not self._open(k):
                continue
            while held and self.sizes[held[0]] > BEHIND * self.sizes[k]:
                self._settle(held[0], [*held[1:], *range(k, len(self.p))])
                if self._open(held[0]):
                    break
                held = [h for h in held[1:] if self._open(h)]
            if not self._open(k):
                continue
            held.append(k)
            if len(held) >= 3:
                a, b, c = (self.sizes[h] for h in held[-3:])
                top = max(abs(b - c), abs(c - a), abs(a - b))
                self._move(held[-3:], ((b - c) / top, (c - a) / top, (a - b) / top) if top else (1.0, -1.0, 0.0))
                held = [h for h in held if self._open(h)]
        self.left = [h for h in held if self._open(h)]

    def land(self) -> None:
        """Decides the last units: two at a time along the token constraint, then the one that is left is drawn."""
        while len(self.left) > 1:
            a, b = (self.sizes[k] for k in self.left[:2])
            self._move(self.left[:2], (b / max(a, b), -a / max(a, b)) if a and b else (1.0, -1.0))
            self.left = [k for k in self.left if self._open(k)]
        for k in self.left:
            self.p[k] = float(self.rng.random() < self.p[k])
        self.left = []


FLOWN = "at long, block long, id string, size long, many long, p double, taken int"


def _fly(seed: str, turn: int, last: bool):
    columns = ["at", "block", "id", "size", "many", "p"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flown(parts: list[pd.DataFrame]) -> pd.DataFrame:
            rows = pd.concat(parts, ignore_index=True)
            flight = Flight(rows["size"].to_numpy() * rows["many"].to_numpy(), rows["p"].to_numpy(), f"{seed}/{turn}/{rows['at'][0]}/{rows['block'][0]}")
            flight.fly()
            if last:
                flight.land()
            p = np.asarray(flight.p)
            rows["p"], rows["taken"] = p, (p > 0.5).astype("int32")
            rows.loc[flight.left, "taken"] = -1
            return rows

        held: list[pd.DataFrame] = []  # of one block, whose rows follow each other
        for pdf in batches:
            for _, part in pdf[columns].groupby(["at", "block"], sort=False):
                if held and (held[0]["at"].iloc[0], held[0]["block"].iloc[0]) != (part["at"].iloc[0], part["block"].iloc[0]):
                    yield flown(held)
                    held = []
                held.append(part)
        if held:
            yield flown(held)

    return run


def mix_decisions(docs: DataFrame, weights: Sequence[float] | DataFrame = (1, 2, 3), cap: float = 3.0, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42, block: int = BLOCK) -> DataFrame:
    """How often each document is taken: id, source, size, many, source_size, target, copies.

    weights: as in targets. Size is the number of words (null text: 0). Rows of equal id,
    source and size are one unit with many rows, taken or left together. A null source is a
    source; a null id is an id. A source without words has target 0 and its documents are
    taken 0 times. No document is taken more than cap times. An empty table gives no rows.
    A source misses its target by less than the last document that is drawn, one of its
    smallest, unless the rest of it has less room than a single large document needs.
    Reruns agree: draws depend on seed, source and the order of hashed ids alone.
    """
    kind = docs.schema[id_col].dataType
    units = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size")).groupBy("id", "source", "size").agg(F.count(F.lit(1)).alias("many"))
    units = cut(units)
    sizes = units.groupBy("source").agg(F.sum(F.col("size") * F.col("many")).alias("total"), F.count(F.lit(1)).alias("units"))
    rate = F.when(F.col("total") > 0, F.least(F.col("target") / F.col("total"), F.lit(cap))).otherwise(0.0)
    plan = targets(sizes, weights, cap).select("at", F.col("source").alias("_source"), F.col("total").alias("source_size"), "target", F.floor(rate + EPS).cast("int").alias("base"), rate.alias("rate"), F.ceil(F.col("units") / block).cast("long").alias("blocks"))
    plan = cut(plan.withColumn("p", F.greatest(F.col("rate") - F.col("base"), F.lit(0.0))).drop("rate"))
    about = plan.agg(F.count(F.lit(1)).alias("sources"), F.max("blocks").alias("blocks")).first()
    sources, blocks = about["sources"], max(1, about["blocks"] or 1)
    planned = _planned(units, plan.select("at", "_source", "blocks", "p"), sources, F.col("id"), lambda a, b: a["source"].eqNullSafe(b["_source"]))
    flying = planned.select("at", F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.greatest("blocks", F.lit(1))).alias("block"), F.col("id").cast("string").alias("id"), "size", "many", "p")
    decided, turn = [], 0
    while True:
        last = blocks <= 1
        dealt = flying.repartition("at", "block").sortWithinPartitions("at", "block", -F.col("size") * F.col("many"), F.xxhash64(F.lit(seed), F.col("id")), "id", "size")
        flown = cut(dealt.mapInPandas(_fly(str(seed), turn, last), FLOWN))
        decided.append(flown.where("taken >= 0").select("at", "id", "size", "many", "taken"))
        if last:
            break
        turn, blocks = turn + 1, -(-blocks // block)
        flying = flown.where("taken < 0").select("at", F.pmod(F.xxhash64(F.lit(seed + turn), F.col("id")), F.lit(blocks)).alias("block"), "id", "size", "many", "p")
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    named = plan.select(F.col("at").alias("_at"), F.col("_source").alias("source"), "source_size", "target", "base")
    return _planned(out, named, sources, F.col("id"), lambda a, b: a["at"] == b["_at"]).select(F.col("id").cast(kind).alias("id"), "source", "size", "many", "source_size", "target", (F.col("base") + F.col("taken")).cast("int").alias("copies"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixed documents: the columns of docs, each row as often as mix_decisions takes it (0 times: gone)."""
    take = mix_decisions(docs, id_col=id_col, text_col=text_col, source_col=source_col, **options).select(F.col("id").alias("_i"), F.col("source").alias("_s"), F.col("size").alias("_n"), F.col("copies").alias("_c")).where("_c > 0")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), F.col(id_col).alias("_id"), F.col(source_col).alias("_source"), word_count(F.col(text_col)).alias("_size"))
    kept = rows.join(take, rows["_id"].eqNullSafe(take["_i"]) & rows["_source"].eqNullSafe(take["_s"]) & (rows["_size"] == take["_n"]))
    return kept.select("_row", F.explode(F.sequence(F.lit(1), F.col("_c")))).select("_row.*")
