"""Quality classifier: perplexity under a Kneser-Ney n-gram model of trusted text.

An interpolated modified Kneser-Ney model per language is counted over the
bytes of every trusted document (byte n-grams pack exactly into a long, need no
vocabulary and make one kind of row for every script).  A document is rejected
if its perplexity lies above its language's quantile over trusted documents
that were held out of the counts.

Documents are dealt into blocks by id.  A block hands in its distinct n-grams,
with their counts in trusted text; counts, continuation counts, discounts and
back-off weights are joins and aggregations sharded by (language, n-gram), and
every block gets back the log-probabilities of its own n-grams.  So what is
gathered and shuffled grows with the corpus, no table of the model is ever
broadcast or collected, and a task holds one block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from equitally.llm.common import TEXT_BATCHES, utf8, write_table

ORDER = 5
QUANTILE = 0.98
BLOCK_BYTES = 32_000_000
#: One in so many trusted documents is held out for the quantiles.
FOLDS = 5
#: Languages with fewer held-out documents take the quantile of all languages.
LEAST_HELD_OUT = 20
#: Bytes of text whose n-grams are in memory at once.
CHUNK = 500_000
ALPHABET = 256


def normal(text: bytes) -> bytes:
    return b" ".join(text.split())


def ngrams(texts: list[bytes], order: int) -> np.ndarray:
    """The n-gram that ends at every byte of every text, as an integer; zero
    bytes stand before a text's first byte."""
    pad = np.zeros(order - 1, np.uint8)
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.concatenate([x for t in texts for x in (pad, np.frombuffer(t, np.uint8))] or [pad]).astype(np.int64)
    n = len(data) - order + 1
    made = np.zeros(max(n, 0), np.int64)
    for j in range(order):
        made = (made << 8) | data[j:j + n]
    inside = np.ones(len(made), bool)
    ends = np.cumsum(sizes + order - 1)[:-1] - (order - 1)  # in ``made``, padding follows each text but the last
    for j in range(order - 1):
        inside[ends + j] = False
    return made[inside]


class Distinct:
    """Distinct n-grams and their counts, from texts as they come."""

    def __init__(self, order: int):
        self.order, self.held, self.size = order, [], 0
        self.grams, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, text: bytes) -> None:
        for at in range(0, len(text), CHUNK):  # a later piece keeps the bytes before it as context
            piece = text[max(0, at - self.order + 1):at + CHUNK]
            self.held.append((piece, min(at, self.order - 1)))
            self.size += len(piece)
            if self.size >= CHUNK:
                self.flush()

    def flush(self) -> None:
        whole = [p for p, before in self.held if not before]
        parts = [ngrams([p], self.order)[before:] for p, before in self.held if before]
        g, c = np.unique(np.concatenate([ngrams(whole, self.order), *parts]), return_counts=True)
        self.held, self.size = [], 0
        self.grams, at = np.unique(np.concatenate([self.grams, g]), return_inverse=True)
        self.counts = np.bincount(at, np.concatenate([self.counts, c]), len(self.grams)).astype(np.int64)


def _block_rows(table: pa.Table):
    """(id, lang, text, trusted, held out) of a block's documents; labels ride along."""
    open_ = zstandard.ZstdDecompressor().decompress
    good: dict[int, int] = {}
    is_label = pa.compute.is_null(table["packed"])
    marks = table.filter(is_label).select(["id", "quality"])
    for id_, quality in zip(marks["id"].to_pylist(), marks["quality"].to_pylist()):
        good[id_] = min(quality, good.get(id_, 1))
    for batch in table.filter(pa.compute.invert(is_label)).select(["id", "lang", "packed", "fold"]).to_batches(max_chunksize=256):
        for r in batch.to_pylist():
            yield r["id"], r["lang"], open_(r["packed"]), good.get(r["id"]) == 1, r["fold"] == 0


def _count(order: int):
    def count(table: pa.Table) -> pa.Table:
        block = table["block"][0].as_py()
        by_lang: dict[str, tuple[Distinct, Distinct]] = {}
        for _, lang, text, trusted, held_out in _block_rows(table):
            by_lang.setdefault(lang, (Distinct(order), Distinct(order)))[trusted and not held_out].add(text)
        made = []
        for lang, both in sorted(by_lang.items()):
            for d in both:
                d.flush()
            (others, _), (grams, counts) = [(d.grams, d.counts) for d in both]
            more = np.setdiff1d(others, grams, assume_unique=True)
            n = len(grams) + len(more)
            made.append(pa.table({"block": pa.array(np.full(n, block, np.int32)), "lang": pa.array([lang]).take(pa.array(np.zeros(n, np.int8))),
                                  "gram": np.concatenate([grams, more]), "n": np.concatenate([counts, np.zeros(len(more), np.int64)])}))
        return pa.concat_tables(made) if made else pa.schema(
            [("block", pa.int32()), ("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]).empty_table()
    return count


def _score(order: int):
    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        known = {}
        for lang in right["lang"].unique().to_pylist():
            own = right.filter(pa.compute.equal(right["lang"], lang)) if right.num_rows else right
            at = np.argsort(own["gram"].to_numpy())
            known[lang] = own["gram"].to_numpy()[at], own["logp"].to_numpy()[at]
        out = []
        for id_, lang, text, trusted, held_out in _block_rows(left):
            total = 0.0
            if text:
                grams, logp = known[lang]
                for at in range(0, len(text), CHUNK):  # a piece keeps the bytes before it as context
                    g = ngrams([text[max(0, at - order + 1):at + CHUNK]], order)[min(at, order - 1):]
                    total += float(logp[np.searchsorted(grams, g)].sum(dtype=np.float64))
            out.append((id_, lang, len(text), total, trusted, trusted and held_out))
        cols = list(zip(*out)) or [()] * 6
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["id", "lang", "n_bytes", "log_p", "trusted", "held_out"])
    return score


SCORE_SCHEMA = "id long, lang string, n_bytes long, log_p double, trusted boolean, held_out boolean"


def _pack(batches):
    squeeze = zstandard.ZstdCompressor(level=6).compress
    for batch in batches:
        packed = pa.array([squeeze(normal(t)) for t in utf8(batch.column("text"))], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("block", "id", "lang", "fold")] + [packed],
                                         ["block", "id", "lang", "fold", "packed"])


def blocks(docs: DataFrame, labels: DataFrame, n_blocks: int) -> DataFrame:
    """Documents (packed text) and labels (packed null), both with their block."""
    def block(id_, otherwise):
        return F.pmod(F.xxhash64(F.coalesce(id_, otherwise)), F.lit(n_blocks)).cast("int").alias("block")

    rows = docs.select(block(F.col("id"), F.xxhash64("text")), "id", "lang",
                       F.pmod(F.xxhash64(F.lit("fold"), "id"), F.lit(FOLDS)).cast("int").alias("fold"), "text") \
        .mapInArrow(_pack, "block int, id long, lang string, fold int, packed binary")
    return rows.withColumn("quality", F.lit(None).cast("int")).unionByName(
        labels.where("id is not null and quality is not null").select(
            block(F.col("id"), F.lit(0)), "id", F.lit(None).cast("string").alias("lang"), F.lit(None).cast("int").alias("fold"),
            F.lit(None).cast("binary").alias("packed"), "quality"))


def continuation_counts(counts: DataFrame, order: int) -> DataFrame:
    """(k, lang, gram, c): counts at the highest order, below it the number of
    different bytes that come before the gram."""
    made = [counts.select(F.lit(order).alias("k"), "lang", "gram", "c")]
    for k in range(order - 1, 0, -1):
        made.append(made[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram"))
                    .agg(F.count("*").alias("c")).select(F.lit(k).alias("k"), "lang", "gram", "c"))
    out = made[0]
    for m in made[1:]:
        out = out.unionByName(m)
    return out


def discounts(counts: DataFrame) -> DataFrame:
    """(k, lang, d1, d2, d3): modified Kneser-Ney discounts from counts of counts,
    held between 0.05 and the count itself; 1/2, 1, 3/2 where those are missing."""
    n = counts.where("c <= 4").groupBy("k", "lang").agg(*[F.count(F.when(F.col("c") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = "n1 / (n1 + 2 * n2)"
    made = {i: F.expr(f"case when n{i} > 0 and n1 > 0 then {i} - {i + 1} * ({y}) * n{i + 1} / n{i} else {i} / 2.0D end") for i in (1, 2, 3)}
    return n.select("k", "lang", *[F.least(F.greatest(d, F.lit(0.05)), F.lit(float(i))).alias(f"d{i}") for i, d in made.items()])


def log_probabilities(grams: DataFrame, counts: DataFrame, order: int, name: str) -> DataFrame:
    """(lang, gram, logp) for distinct (lang, gram) of the highest order.

    ``counts`` (lang, gram, c) are the trusted text's.  P_k(g) = max(c - D, 0) /
    S(context) + weight(context) P_{k-1}(g without its first byte); a context
    never seen passes the lower order through; below order 1 every byte has 1/256.
    """
    every = write_table(continuation_counts(counts, order), f"{name}-counts", order * counts.count())
    d = write_table(discounts(every), f"{name}-discounts")  # order x languages rows; its size is known from here
    rows = every.join(d, ["k", "lang"]).withColumn("d", F.expr("case c when 1 then d1 when 2 then d2 else d3 end")) \
        .select("k", "lang", "gram", "c", "d")
    found = None
    for k in range(1, order + 1):
        ask = grams.select("lang", F.col("gram").bitwiseAND((1 << 8 * k) - 1).alias("gram"))
        ask = (ask if k == order else ask.distinct()).withColumn("context", F.shiftright("gram", 8))
        own = rows.where(F.col("k") == k)
        context = own.groupBy("lang", F.shiftright("gram", 8).alias("context")).agg(F.sum("c").alias("s"), F.sum("d").alias("held"))
        p = ask.join(own.select("lang", "gram", (F.col("c") - F.col("d")).alias("left")), ["lang", "gram"], "left") \
            .join(context, ["lang", "context"], "left").withColumn("lower", F.col("gram").bitwiseAND((1 << 8 * (k - 1)) - 1))
        if found is None:
            p = p.withColumn("p_low", F.lit(1.0 / ALPHABET))
        else:
            p = p.join(found.select("lang", F.col("gram").alias("lower"), F.col("p").alias("p_low")), ["lang", "lower"])
        found = p.select("lang", "gram", F.expr(
            "case when s is null then p_low else coalesce(left, 0) / s + held / s * p_low end").alias("p"))
    return found.select("lang", "gram", F.log("p").cast("float").alias("logp"))


def perplexities(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
                 quality_col: str = "quality", toxic_col: str = "toxic", order: int = ORDER, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document row: id, lang ('' if null), n_bytes (white space
    folded), log_p, trusted, held_out; a written table."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    toxic = F.coalesce(F.col(toxic_col).cast("int"), F.lit(0)) if toxic_col in labels.columns else F.lit(0)
    marks = labels.select(F.col(id_col).cast("long").alias("id"), F.when(toxic > 0, 0).otherwise(F.col(quality_col).cast("int")).alias("quality")) \
        .groupBy("id").agg(F.min("quality").alias("quality"))  # labels of a repeated id are one row of its block
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    dealt = blocks(rows, marks, max(1, -(-size // block_bytes)))
    grams = write_table(dealt.groupBy("block").applyInArrow(_count(order), "block int, lang string, gram long, n long"), "quality-grams", settings=TEXT_BATCHES)
    counts = write_table(grams.groupBy("lang", "gram").agg(F.sum("n").alias("c")), "quality-types", grams.count())
    logp = write_table(log_probabilities(counts, counts.where("c > 0"), order, "quality"), "quality-logp", counts.count())
    given = write_table(grams.select("block", "lang", "gram").join(logp, ["lang", "gram"]).select("block", "lang", "gram", "logp"), "quality-given", grams.count())
    return write_table(dealt.groupBy("block").cogroup(given.groupBy("block")).applyInArrow(_score(order), SCORE_SCHEMA), "quality-scores", settings=TEXT_BATCHES)


def classify(docs: DataFrame, labels: DataFrame, quantile: float = QUANTILE, **settings) -> DataFrame:
    """One row per document row: doc_id, lang, n_bytes, perplexity, threshold, keep.

    Trusted are documents that ``labels`` calls quality 1, never 0 and never
    toxic (a missing or null toxic label is none).  Empty and null texts have no perplexity and are rejected.  A language without
    held-out trusted documents has no threshold and is kept; one with few of
    them takes the quantile over all languages.  A null language is one of its
    own; null ids and repeated rows are scored as they come; without labels
    everything but empty text is kept.  An empty table gives no rows.
    """
    scored = perplexities(docs, labels, **settings).withColumn(
        "perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))
    held = scored.where("held_out and n_bytes > 0")
    cut = F.percentile_approx("perplexity", quantile, 10_000)
    all_languages = held.agg(cut).first()[0]  # one number
    thresholds = write_table(held.groupBy("lang").agg(cut.alias("own"), F.count("*").alias("n")).select(
        "lang", F.when(F.col("n") >= LEAST_HELD_OUT, F.col("own")).otherwise(F.lit(all_languages).cast("double")).alias("threshold")),
        "quality-thresholds")
    return scored.join(thresholds, "lang", "left").select(
        F.col("id").alias("doc_id"), "lang", "n_bytes", "perplexity", "threshold",
        (F.col("perplexity").isNotNull() & (F.col("threshold").isNull() | (F.col("perplexity") <= F.col("threshold")))).alias("keep"))
