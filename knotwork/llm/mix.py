"""Mixing sources to target shares of tokens, by weighted sampling without replacement within each source.

Each record draws an exponential key, scaled by its quality weight (Efraimidis and Spirakis): -ln(u) / weight, u
from a hash of the record, so that any run draws the same. A source's budget is met by complete epochs first, every
record once per epoch; the rest goes to records in key order until the prefix sum of their tokens reaches it.

The prefix sum needs no sort of a whole source. A histogram of a source's keys says in which of its bars the budget
ends; that bar gets a histogram of its own, and so on until it holds few records, whatever the weights. Only these
are sorted. The driver holds one bar per source and round.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from knotwork.functions.arrow import arrow_schema
from knotwork.llm.mail import texts
from knotwork.session import spool

MEASURED = "record string, doc_id long, source string, n_tokens long, quality double"
#: Bars of a histogram of keys.
BUCKETS = 4096
#: Records of a source that are sorted at most.
SORTED = 65_536
# Fixed value: the pattern that the public byte-level vocabularies split words by.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def vocabulary_path(name: str = "byte_bpe_50k.tiktoken") -> str:
    """Where the installed public tokenizers keep a vocabulary file."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return f"/opt/tokenizers/{name}"


@dataclass(frozen=True)
class Mix:
    """``total`` tokens to reach, None: the most that every source can give its share of; the vocabulary; the draw."""

    total: int | None = None
    vocabulary: str | None = None
    seed: int = 17


def quality(raw: str | None) -> float:
    """Weight of a text between 0.1 and 1: letters and blanks among its readable characters, short texts less."""
    body = " ".join(texts(raw))
    if not body:
        return 0.1
    plain = sum(map(str.isalpha, body)) + body.count(" ")
    return 0.1 + 0.9 * min(1.0, plain / len(body)) * min(1.0, len(body) / 500)


_encoders: dict[str, object] = {}


def encoder(path: str):
    """The tokenizer of a vocabulary file, once per process."""
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _encoders[path] = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def _measurer(path: str):
    schema = arrow_schema(MEASURED)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            bodies = batch.column(3).to_pylist()
            tokens = pa.array([0 if not x else len(encode(x.encode("utf-8", "replace").decode())) for x in bodies], pa.int64())
            weights = pa.array([quality(x) for x in bodies], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), tokens, weights], schema=schema)

    return measure


def source_name(column: str) -> F.Column:
    """A source's name without outer blanks and regardless of case."""
    return F.lower(F.regexp_replace(F.col(column), r"^\s+|\s+$", ""))


def measure(documents: DataFrame, mix: Mix) -> DataFrame:
    """One row per mail with its size in tokens and weight; a mail archived twice is one, under its smallest id.

    Mails are the same if they share a ``message_id``; one without, null or blank, is itself. Null ids are no documents, a null or
    empty text has no tokens, a null source no name and so no share.
    """
    named = F.when(F.trim("message_id") != "", F.col("message_id"))
    name = F.coalesce(F.concat(F.lit("m"), named), F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    rows = documents.where("doc_id is not null").select(
        name.alias("record"), F.col("doc_id").cast("long"), source_name("source").alias("source"), "text"
    )
    path = mix.vocabulary or vocabulary_path()
    measured = rows.mapInArrow(_measurer(path), MEASURED)
    first = F.min(F.struct("doc_id", "source", "n_tokens", "quality")).alias("r")
    return measured.groupBy("record").agg(first).select("record", "r.*")


@dataclass(frozen=True)
class Budget:
    source: str
    share: float
    repeats: int
    available: int
    tokens: float

    @property
    def epochs(self) -> int:
        return min(self.repeats, int(self.tokens // self.available)) if self.available else 0

    @property
    def rest(self) -> float:
        return self.tokens - self.epochs * self.available if self.epochs < self.repeats else 0.0


def budgets(targets: list, available: dict[str, int], total: int | None) -> list[Budget]:
    """Each source's tokens: its share of the total, at most what its repeats allow. Shares are brought to sum 1."""
    named: dict[str, tuple[float, int]] = {}
    for source, share, repeats in targets:
        if source is not None:
            before = named.get(source, (0.0, 0))
            named[source] = (before[0] + max(0.0, share or 0.0), max(before[1], repeats or 0))
    weight = sum(s for s, _ in named.values()) or 1.0
    most = [available.get(n, 0) * r / (s / weight) for n, (s, r) in named.items() if s > 0 and available.get(n, 0) * r > 0]
    goal = total if total is not None else min(most, default=0)
    return [
        Budget(n, s / weight, r, available.get(n, 0), min(goal * s / weight, float(available.get(n, 0) * r)))
        for n, (s, r) in sorted(named.items())
    ]


def _cuts(drawn: DataFrame, rest: dict[str, float]) -> list[tuple[str, float, float, int]]:
    """(source, low, high, before) of each source whose ``rest`` ends within it: among its records with keys from low
    to high, at most ``SORTED``, below which ``before`` tokens lie."""
    spark = drawn.sparkSession
    spans = drawn.groupBy("source").agg(F.min("key"), F.max("key"), F.count(F.lit(1)), F.sum("n_tokens")).collect()
    todo = [(s, low, high, 0, n) for s, low, high, n, held in spans if 0 < rest.get(s, 0.0) < held]
    done = []
    while todo:
        done += [t[:4] for t in todo if t[4] <= SORTED or t[1] == t[2]]
        todo = [t for t in todo if t[4] > SORTED and t[1] < t[2]]
        if not todo:
            break
        bars = F.broadcast(
            spark.createDataFrame([(*t[:4], rest[t[0]]) for t in todo], "source string, low double, high double, before long, rest double")
        )
        inside = drawn.join(bars, "source").where("key between low and high")
        bar = F.least(F.floor((F.col("key") - F.col("low")) / (F.col("high") - F.col("low")) * BUCKETS), F.lit(BUCKETS - 1))
        sums = inside.groupBy("source", bar.alias("bar"), "before", "rest").agg(
            F.sum("n_tokens").alias("held"), F.count(F.lit(1)).alias("n"), F.min("key").alias("first"), F.max("key").alias("last")
        )
        upto = Window.partitionBy("source").orderBy("bar").rowsBetween(Window.unboundedPreceding, -1)
        placed = sums.withColumn("below", F.col("before") + F.coalesce(F.sum("held").over(upto), F.lit(0)))
        ends = placed.where("below <= rest and below + held > rest")
        todo = [tuple(r) for r in ends.select("source", "first", "last", "below", "n").collect()]
    return done


def mix_sources(documents: DataFrame, targets: DataFrame, mix: Mix | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, report): the records used with their number of uses, and per source what came out.

    A source's tokens stay below its budget by less than the record that would not fit. Sources without target
    take no part; a target without records is reported with nothing. ``targets`` is one row per source: small.
    """
    mix = mix or Mix()
    spark = documents.sparkSession
    wanted = [tuple(r) for r in targets.select(source_name("source").alias("source"), "target_share", "max_repeats").collect()]
    names = [w[0] for w in wanted if w[0] is not None]
    u = (F.shiftrightunsigned(F.xxhash64("record", F.lit(mix.seed)), 11) + 1) / F.lit(float(1 << 53))
    drawn = spool(
        measure(documents, mix)
        .where(F.col("source").isin(names) if names else F.lit(False))
        .withColumn("key", -F.log(u) / F.col("quality"))
    )
    available = {r[0]: r[1] for r in drawn.groupBy("source").agg(F.sum("n_tokens")).collect()}
    plan = budgets(wanted, available, mix.total)
    table = F.broadcast(
        spark.createDataFrame(
            [(b.source, b.share, b.repeats, b.available, float(b.tokens), b.epochs, float(b.rest)) for b in plan],
            "source string, target_share double, max_repeats int, available_tokens long, budget_tokens double, epochs int, rest double",
        )
    )
    cuts = _cuts(drawn, {b.source: b.rest for b in plan})
    cut = F.broadcast(spark.createDataFrame(cuts, "source string, low double, high double, before long"))
    placed = drawn.join(table, "source").join(cut, "source", "left")
    sure = placed.where("low is null or key < low or key > high").withColumn(
        "extra", F.when(F.col("low").isNull(), F.col("rest") > 0).otherwise(F.col("key") < F.col("low")).cast("int")
    )
    within = Window.partitionBy("source").orderBy("key", "record").rowsBetween(Window.unboundedPreceding, 0)
    sorted_ = placed.where("key between low and high").withColumn(
        "extra", (F.col("before") + F.sum("n_tokens").over(within) <= F.col("rest")).cast("int")
    )
    every = sure.unionByName(sorted_)
    used = every.withColumn("uses", F.col("epochs") + F.col("extra")).where("uses > 0")
    records = used.select("doc_id", "source", "n_tokens", "uses")
    mixed = records.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("uses")).alias("mixed_tokens"), F.count(F.lit(1)).alias("n_records"), F.sum("uses").alias("n_uses")
    )
    report = table.join(mixed, "source", "left").fillna(0, ["mixed_tokens", "n_records", "n_uses"])
    overall = Window.partitionBy()  # one row per target
    report = report.withColumn("actual_share", F.col("mixed_tokens") / F.greatest(F.sum("mixed_tokens").over(overall), F.lit(1)))
    return records, report.drop("epochs", "rest")
