"""Operator 4: perplexity under an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .exchange import BLOB, blob_table, bounded_batches, let_go, pack_shards, part_count, private, squeezed, text_bytes, unsqueezed, written
from .text import buffers, chunks, mix

ORDER = 5  # bytes
TRUSTED_IDS = 8 << 20  # trusted ids of which more are not broadcast
LANGUAGES = 100_000
PRIOR_BYTES = 32
FOLDS = 2  # by hash of the text; a document is scored by the model of the trusted text of all other folds
KEYS_BYTES = 1 << 20  # of text whose grams are held at once
HELD_ROWS = 1 << 20  # distinct grams that a counting task holds before it passes them on
SCORED = T.StructType().add("doc_id", "long").add("lang", "string").add("version", "long").add("text", "string").add("n_bytes", "long").add("log_p", "double")


def _grams(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The last ORDER bytes up to each byte of its text, zeros before the text, as one number."""
    at = np.arange(len(data)) + np.repeat(np.arange(1, len(offsets)), np.diff(offsets)) * (ORDER - 1)
    padded = np.zeros(len(data) + (ORDER - 1) * len(offsets), np.int64)
    padded[at] = data
    out = padded.copy()
    for back in range(1, ORDER):
        out[back:] |= padded[:-back] << (8 * back)
    return out[at]


def count_grams(texts: DataFrame) -> DataFrame:
    """(fold, gram, c): how often each gram occurs in all of ``texts(fold, text)``, counted in tasks first and then by shard."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def merged() -> tuple[np.ndarray, np.ndarray]:
            keys, inverse = np.unique(np.concatenate([k for k, _ in held]), return_inverse=True)
            return keys, np.bincount(inverse, np.concatenate([c for _, c in held])).astype(np.int64)

        def passed(pair: tuple[np.ndarray, np.ndarray]) -> Iterator[pa.RecordBatch]:
            for k in range(0, len(pair[0]), 1 << 16):
                keys = pair[0][k : k + (1 << 16)]
                yield pa.RecordBatch.from_pydict({"fold": (keys >> (8 * ORDER)).astype(np.int32), "gram": keys & ((1 << (8 * ORDER)) - 1), "c": pair[1][k : k + (1 << 16)]})

        for batch in batches:
            data, offsets = buffers(batch["text"])
            folds = batch["fold"].to_numpy().astype(np.int64)
            for i, j in chunks(offsets):
                own = offsets[i : j + 1] - offsets[i]
                keys = _grams(data[offsets[i] : offsets[j]], own) | (np.repeat(folds[i:j], np.diff(own)) << (8 * ORDER))
                held.append(np.unique(keys, return_counts=True))
                if sum(len(k) for k, _ in held) > HELD_ROWS:
                    pair = merged()
                    held = [pair]
                    if len(pair[0]) > HELD_ROWS // 2:
                        yield from passed(pair)
                        held = []
        if held:
            yield from passed(merged())

    return texts.select("fold", "text").mapInArrow(count, "fold int, gram long, c long").groupBy("fold", "gram").agg(F.sum("c").alias("c"))


def discounts(n: list[int]) -> list[float]:
    """The three discounts of modified Kneser-Ney from how many grams have counts 1, 2, 3 and 4."""
    n1, n2, n3, n4 = n
    if not (n1 and n2 and n3):
        return [0.5, 1.0, 1.5]
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), cap) for d, cap in ((1 - 2 * y * n2 / n1, 0.95), (2 - 3 * y * n3 / n2, 1.95), (3 - 4 * y * n4 / n3, 2.95))]


def kneser_ney(counts: DataFrame) -> DataFrame:
    """The model (level, gram, log_p, log_rest) of ``counts(gram, c)``.

    A gram's row holds its log-probability given its context (null: the row stands for a context
    alone) and the log-weight that the gram as a context leaves to the level below. Lower levels
    count by how many different bytes a gram follows. All joins are between sharded count tables.
    """
    tables = {ORDER: written(counts)}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)).alias("gram")).agg(F.count("*").alias("c")))
    model, below = None, None
    for k in range(1, ORDER + 1):
        t = tables[k].withColumn("context", F.shiftright("gram", 8))
        n = t.agg(*(F.count_if(F.col("c") == i).alias(f"n{i}") for i in range(1, 5))).first()
        d = discounts(list(n))
        size = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        contexts = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum(size).alias("taken"))
        joined = t.join(contexts, "context").withColumn("lower", F.col("gram").bitwiseAND(F.lit((1 << (8 * (k - 1))) - 1)))
        if below is None:
            joined = joined.withColumn("p_lower", F.lit(1 / 256))
        else:
            joined = joined.join(below.select(F.col("gram").alias("lower"), F.col("p").alias("p_lower")), "lower")
        p = (F.col("c") - size + F.col("taken") * F.col("p_lower")) / F.col("total")
        probs = written(joined.select("gram", p.alias("p")))
        rest = contexts.select(F.col("context").alias("gram"), F.log(F.col("taken") / F.col("total")).alias("log_rest"))
        rows = (
            probs.select(F.lit(k).alias("level"), "gram", F.log("p").alias("log_p"), F.lit(None).cast("double").alias("log_rest"))
            .unionByName(rest.select(F.lit(k - 1).alias("level"), "gram", F.lit(None).cast("double").alias("log_p"), "log_rest"))
        )
        model, below = (rows if model is None else model.unionByName(rows)), probs
    return model.groupBy("level", "gram").agg(F.max("log_p").alias("log_p"), F.max("log_rest").alias("log_rest"))


def gram_scores(asked: DataFrame, model: DataFrame) -> DataFrame:
    """``asked(key, ...)`` with log_p, the log-probability of each key under ``model(fold, level, gram, ...)``; a key is a fold and a gram of full order.

    Joins of the distinct grams with the sharded model: at each level a gram that the level knows
    is settled, any other takes on its context's weight and goes down.
    """
    open_ = asked.withColumns({"_fold": F.shiftright("key", 8 * ORDER).cast("int"), "gram": F.col("key").bitwiseAND(F.lit((1 << (8 * ORDER)) - 1)), "found": F.lit(None).cast("double"), "rest": F.lit(0.0)})
    for k in range(ORDER, 0, -1):
        at = lambda level, name: model.where((F.col("level") == level) & F.col(name).isNotNull()).select(F.col("fold").alias("_fold"), F.col("gram").alias("_key"), F.col(name).alias("_value"))
        open_ = open_.withColumn("_key", F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1))).join(at(k, "log_p"), ["_fold", "_key"], "left")
        open_ = open_.withColumn("found", F.coalesce("found", F.col("rest") + F.col("_value"))).drop("_key", "_value")
        open_ = open_.withColumn("_key", F.shiftright(F.col("gram").bitwiseAND(F.lit((1 << (8 * k)) - 1)), 8)).join(at(k - 1, "log_rest"), ["_fold", "_key"], "left")
        open_ = open_.withColumn("rest", F.col("rest") + F.coalesce("_value", F.lit(0.0))).drop("_key", "_value")
    return open_.select(*asked.columns, F.coalesce("found", F.col("rest") + F.log(F.lit(1 / 256))).alias("log_p"))


def _chunk_keys(texts: pa.Array | pa.ChunkedArray, folds: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets of the texts, key of each byte), a bounded run of texts at a time: keys take many times the room of their text."""
    data, offsets = buffers(texts)
    folds = folds.astype(np.int64)
    for i, j in chunks(offsets, KEYS_BYTES):
        own = offsets[i : j + 1] - offsets[i]
        if own[-1]:
            keys = _grams(data[offsets[i] : offsets[j]], own)
            keys |= np.repeat(folds[i:j], np.diff(own)) << (8 * ORDER)
            yield i, own, keys


def _coded(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    distinct, inverse = np.unique(keys, return_inverse=True)
    return distinct, inverse.astype(np.int32 if len(distinct) < 1 << 31 else np.int64)


def _ascending(keys: list[np.ndarray]) -> np.ndarray:
    """The distinct ones of all keys (none below 0), by sorting: several times as fast as ``np.unique`` with its hash table."""
    found = np.sort(np.concatenate([np.zeros(0, np.int64), *keys]))
    return found[np.diff(found, prepend=-1) != 0]


def _distinct(table: pa.Table) -> np.ndarray:
    """The distinct keys of a part's texts, ascending."""
    return _ascending([_ascending([keys]) for _, _, keys in _chunk_keys(unsqueezed(table)["text"], table["fold"].to_numpy())])


def _packed(keys: np.ndarray) -> bytes:
    """Ascending keys as differences, byte plane by byte plane: empty planes vanish in Spark's compression."""
    return np.diff(keys, prepend=np.int64(0)).astype("<i8").view(np.uint8).reshape(-1, 8).T.tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(blob, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<i8").ravel(), dtype=np.int64)


def _by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """(shard, positions of its keys in order) of ascending keys; a shard is a range of their hashes."""
    hashes = mix(keys.astype(np.uint64))
    by = np.argsort(hashes)
    return [(s, np.sort(by[i:j])) for s, i, j in pack_shards(hashes[by], shards)]


def _scored(docs: DataFrame, model: DataFrame, kept: list[str], keep_text: bool) -> DataFrame:
    """(row, doc_id, lang, version[, text], n_bytes, log_p) of all documents, one row per input row, written; ``row`` holds the columns ``kept``.

    The distinct grams of all texts, gathered in packed blobs by shard, are scored by joins with the
    model. Then parts of the documents, by hash, ask shards for each of their distinct grams once,
    and shards answer. Neither the model nor any part's grams pass through the driver.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    rows = docs.select(
        F.struct(*(F.col(c) for c in kept), F.lit(None).cast("int").alias(private(kept, "row")[0])).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
        _version(text).alias("version"), _fold(text).alias("fold"), text.alias("text"),
    )
    count = part_count(rows, text_bytes(rows))
    parts = squeezed(rows.withColumn("part", F.pmod(F.xxhash64("doc_id", "version"), F.lit(count)).cast("int"))).repartition(count, "part")

    def ask(table: pa.Table) -> pa.Table:
        keys = _distinct(table)
        return blob_table([(s, table["part"][0].as_py(), _packed(keys[at])) for s, at in _by_shard(keys, count)])

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)
        for batch in batches:
            for _, _, keys in _chunk_keys(batch["text"], batch["fold"].to_numpy()):
                held = _ascending([held, _ascending([keys])])
                if len(held) > HELD_ROWS:
                    yield from blob_table([(s, 0, _packed(held[at])) for s, at in _by_shard(held, count)]).to_batches()
                    held = held[:0]
        if len(held):
            yield from blob_table([(s, 0, _packed(held[at])) for s, at in _by_shard(held, count)]).to_batches()

    def wanted(table: pa.Table) -> pa.Table:
        keys = _ascending([_unpacked(b) for b in table["blob"].to_pylist()])
        return pa.table({"shard": pa.array(np.full(len(keys), table["shard"][0].as_py()), pa.int32()), "key": pa.array(keys)})

    def answer(asks: pa.Table, known: pa.Table) -> pa.Table:
        keys, log_p = known["key"].to_numpy(), known["log_p"].to_numpy()
        by = np.argsort(keys)
        keys, log_p = keys[by], log_p[by]
        told = [log_p[np.searchsorted(keys, _unpacked(b))].astype("<f4").tobytes() for b in asks["blob"].to_pylist()]
        return blob_table(list(zip(asks["part"].to_pylist(), asks["shard"].to_pylist(), told, strict=True)), ("part", "shard"))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        n_bytes, log_p = np.zeros(table.num_rows, np.int64), np.zeros(table.num_rows)
        runs = [(i, own, *_coded(keys)) for i, own, keys in _chunk_keys(unsqueezed(table)["text"], table["fold"].to_numpy())] if table.num_rows else []
        if runs:
            keys = _ascending([distinct for _, _, distinct, _ in runs])
            value = np.zeros(len(keys))
            told = dict(zip(answers["shard"].to_pylist(), answers["blob"].to_pylist(), strict=True))
            for s, at in _by_shard(keys, count):
                value[at] = np.frombuffer(told[s], "<f4")
        while runs:
            i, own, distinct, inverse = runs.pop()
            each, size = value[np.searchsorted(keys, distinct)][inverse], np.diff(own)
            full = np.flatnonzero(size)
            n_bytes[i + full] = size[full]
            log_p[i + full] = np.add.reduceat(each, own[:-1][full])  # text by text: equal texts get equal sums
        plain = unsqueezed(table) if keep_text else table
        text = plain["text"].combine_chunks() if keep_text else pa.nulls(table.num_rows)
        return table.select(["row", "doc_id", "lang", "version"]).append_column("text", text.cast(pa.string())).append_column("n_bytes", pa.array(n_bytes, pa.int64())).append_column("log_p", pa.array(log_p, pa.float64()))

    asks = parts.groupBy("part").applyInArrow(ask, BLOB)
    seen = rows.select("fold", "text").mapInArrow(gathered, BLOB)  # from the scan's own tasks: the texts stay where they are
    asked = written(seen.groupBy("shard").applyInArrow(wanted, "shard int, key long"))
    known = written(gram_scores(asked, model))
    let_go(spark)  # what the model and the joins shuffled, before the texts are
    answers = asks.groupBy("shard").cogroup(known.groupBy("shard")).applyInArrow(answer, "part int, shard int, blob binary")
    schema = T.StructType([rows.schema["row"], *SCORED.fields])
    scored = parts.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(score, schema)
    return written(scored if keep_text else scored.drop("text"))


def _version(text: Column) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


def _fold(text: Column) -> Column:
    """Exact copies share a fold, so that no model that judges a text has counted it."""
    return F.pmod(_version(text), F.lit(FOLDS)).cast("int")


def _with(scores: DataFrame, by_lang: DataFrame, overall: DataFrame, name: str) -> DataFrame:
    """Adds the language's value, or else that over all languages; a table of a row for each language is broadcast up to ``LANGUAGES``."""
    keyed = scores.withColumns({"_l": F.coalesce("lang", F.lit("")), "_n": F.col("lang").isNull()})
    own = F.broadcast(by_lang) if by_lang.count() <= LANGUAGES else by_lang
    both = keyed.join(own, ["_l", "_n"], "left").join(F.broadcast(overall), F.lit(True), "left")
    return both.withColumn(name, F.coalesce("_own", "_all")).drop("_l", "_n", "_own", "_all")


def _quantiles(known: DataFrame, column: str, quantile: float) -> tuple[DataFrame, DataFrame]:
    at = F.percentile_approx(column, quantile, 10_000)
    keys = F.coalesce("lang", F.lit("")).alias("_l"), F.col("lang").isNull().alias("_n")
    return written(known.groupBy(*keys).agg(at.alias("_own"))), written(known.agg(at.alias("_all")))


def _judged(scores: DataFrame, trusted: DataFrame, quantile: float) -> DataFrame:
    """Adds perplexity, ``adjusted``, threshold and ``accepted`` to written scores."""
    scores = scores.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.exp(-F.col("log_p") / F.col("n_bytes"))))
    narrow = scores.select("doc_id", "lang", "n_bytes", "log_p", "perplexity").where("n_bytes > 0")
    known = written(narrow.join(trusted, "doc_id", "left_semi"))
    middle = _quantiles(known, "perplexity", 0.5)
    mean = (-F.col("log_p") + PRIOR_BYTES * F.log("middle")) / (F.col("n_bytes") + PRIOR_BYTES)
    adjust = lambda rows: _with(rows, *middle, "middle").withColumn("adjusted", F.when(F.col("n_bytes") > 0, F.coalesce(F.exp(mean), "perplexity"))).drop("middle")
    judged = _with(adjust(scores), *_quantiles(adjust(known), "adjusted", quantile), "threshold")
    return judged.withColumn("accepted", F.coalesce(F.col("adjusted") <= F.col("threshold"), F.lit(True)))


def _fit(docs: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the folds' models, trusted ids)."""
    bounded_batches(docs.sparkSession)
    trusted = written(labels.where("quality = 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id")).distinct())
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), _fold(text).alias("fold"))
    texts = rows.join(F.broadcast(trusted) if trusted.count() <= TRUSTED_IDS else trusted.hint("merge"), "doc_id", "left_semi").select("fold", "text")
    counts = written(count_grams(texts))
    models = [written(kneser_ney(counts.where(F.col("fold") != f).groupBy("gram").agg(F.sum("c").alias("c")))).withColumn("fold", F.lit(f)) for f in range(FOLDS)]
    let_go(docs.sparkSession)
    return reduce(DataFrame.unionByName, models), trusted


def quality_scores(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """Perplexity of each document and whether it is accepted.

    The models are trained on all text that ``labels(doc_id, quality)`` trusts (quality 1): texts
    fall into folds by their hash, and each, trusted or not, is scored by the model of the other
    folds' trusted text. So trusted texts get the perplexities that others like them would. (Near
    copies may lie in different folds.) Where the other folds hold no trusted text, all bytes are
    alike. Grams of bytes make a model independent of word forms. A document's perplexity is per byte; ``adjusted`` is
    the same with a prior of 32 bytes at the language's median, so that a few odd bytes don't
    condemn a tiny text. A language's threshold is the ``quantile`` of the adjusted
    perplexities of its trusted documents; a language without any takes that of all languages.
    Up to ``TRUSTED_IDS`` trusted ids find their texts by a broadcast join, more by a sort-merge join;
    counts, models and scores are joins of sharded tables at every size.

    ``docs(doc_id, text, lang)``, other columns ignored, whatever their names; returns (doc_id, version, lang, n_bytes, perplexity, adjusted,
    threshold, accepted), one row per input row, version being a hash of the text. Null and empty
    texts have perplexity null and are accepted: there is nothing to object to. A long text is scored whole. Repeated rows count and are judged each by itself, ties at the threshold are accepted. A null lang is a
    language of its own. Several labels of an id count as the largest. Without any trusted text
    all documents are accepted. An empty table gives an empty one.
    """
    model, trusted = _fit(docs, labels)
    return _judged(_scored(docs, model, [], False).drop("row"), trusted, quantile).select("doc_id", "version", "lang", "n_bytes", "perplexity", "adjusted", "threshold", "accepted")


def accepted_documents(docs: DataFrame, labels: DataFrame, quantile: float = 0.99) -> DataFrame:
    """The rows of ``docs`` that ``quality_scores`` accepts, with all their columns unchanged."""
    model, trusted = _fit(docs, labels)
    kept = [c for c in docs.columns if c != "text"]
    judged = _judged(_scored(docs.withColumn("text", F.col("text").cast("string")), model, kept, True), trusted, quantile)
    return judged.where("accepted").select(*(F.col("text") if c == "text" else F.col("row").getField(c).alias(c) for c in docs.columns))
