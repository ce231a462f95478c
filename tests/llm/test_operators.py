"""Each operator against a plain version, on rows with nulls, empty and long texts, copies and repeats."""

import gzip
import hashlib
import io
import re
import tarfile
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakecover.llm import sql
from lakecover.llm.decontaminate import NgramIndex, decontaminate
from lakecover.llm.jaccard import PrefixTree, ngram_jaccard_join, similar_pairs
from lakecover.llm.lines import line_dedup, line_suffixes
from lakecover.llm.exchange import open_shared, shared_folder
from lakecover.llm.media import canonical_places, media_columns, media_features, media_table, write_shards
from lakecover.llm.mixture import mix_sources
from lakecover.llm.quality import accepted_documents, discounts, quality_scores
from lakecover.llm.substrings import COVER, PERIOD, substring_dedup
from lakecover.llm.text import SPACE_SEPARATORS, Words, buffers
from lakecover.llm.toxicity import BoostedTrees, fit_toxicity, held_out, isotonic, toxicity
from lakecover.llm.warc import LoserTree, archive_pages, lost_revisits, merge_index, read_archives, records_in, url_key, write_archives

SPACE = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_words_match_the_pattern():
    import pyarrow as pa

    texts = ["", "a", " a b\tc\n", "é ß", "x" * 50, None, "last "]
    words = Words(*buffers(pa.array(texts)), SPACE_SEPARATORS)
    assert list(words.counts) == [len(SPACE.findall(t or "")) for t in texts]
    assert len(set(words.hashes())) == len({w for t in texts for w in SPACE.findall(t or "")})


# -- 9


def plain_substrings(rows, length=13):
    first = {}
    big = 1 << 62
    texts = [(big if d is None else d, SPACE.findall(t or "")) for d, t in rows]
    for d, w in sorted(texts, key=lambda x: x[0]):
        for i in range(len(w) - length + 1):
            first.setdefault(tuple(w[i : i + length]), d)
    out = []
    for d, w in texts:
        gone = {p for i in range(len(w) - length + 1) if first[tuple(w[i : i + length])] < d for p in range(i, i + length)}
        out.append((None if d == big else d, len(w), len(gone), sha(" ".join(x for p, x in enumerate(w) if p not in gone))))
    return out


@pytest.mark.parametrize("length", [8, 13])
def test_substring_dedup(docs, rows, length):
    got = substring_dedup(docs, length).collect()
    assert Counter(tuple(r[:4]) for r in got) == Counter(plain_substrings([r[:2] for r in rows], length))
    assert all(sha(r.kept_text) == r.kept_sha256 for r in got)


def test_difference_cover_meets_every_shift():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_substring_dedup_of_nothing(empty):
    assert substring_dedup(empty).count() == 0


# -- 2


def plain_decontamination(rows, items, n=10):
    wins = defaultdict(set)
    for item, text in items:
        w = ALNUM.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - n + 1)) if w else ():
            wins[tuple(w[i : i + n])].add(str(item))
    out = []
    for d, t in rows:
        w = ALNUM.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for size in {len(x) for x in wins}:
            for i in range(len(w) - size + 1):
                if tuple(w[i : i + size]) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[tuple(w[i : i + size])]
        out.append((d, len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    return out


@pytest.mark.parametrize("block_bytes", [1 << 25, 400])
def test_decontaminate(spark, docs, rows, block_bytes):
    items = [(3, rows[8][1]), (20, rows[9][1].upper()), (100, "two, THREE"), (7, None), (8, "..."), (9, rows[8][1]), (11, "é")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    clash = docs.withColumns({c: F.lit("clash") for c in ("n_hit", "_hits", "_items")})
    got = decontaminate(clash, bench, clean=True, block_bytes=block_bytes).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter(plain_decontamination([r[:2] for r in rows], items))
    again = decontaminate(spark.createDataFrame([(r.doc_id, r.clean_text) for r in got], "doc_id long, text string"), bench)
    assert again.where("contaminated").count() == 0
    assert all((r.clean_text is None) == (r.text is None) and (r.n_hit or r.clean_text == r.text) for r in got)


def test_index_stays_small():
    texts = pa.array([" ".join(f"word{(i * k) % 977}" for i in range(2000)) for k in range(1, 40)])
    index = NgramIndex(list(range(39)), texts, 10)
    assert index.bytes_held() < 4 * sum(map(len, texts.to_pylist()))


def test_decontaminate_nothing(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate(docs, none).where("contaminated").count() == 0
    assert decontaminate(empty, none).count() == 0


# -- 3


def test_mixture_against_sql(spark, docs, rows):
    got = mix_sources(docs.withColumn("size", F.lit("clash")))
    assert "lang" in got.columns
    con = duckdb.connect()
    documents = got.sparkSession.createDataFrame(rows, docs.schema).toPandas()
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    con.register("documents", documents)
    want = Counter(con.sql(sql.OP3).fetchall())
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "source_size", F.col("target"), "taken").collect()) == want


def test_mixture_meets_its_targets(spark):
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.pmod(F.hash("id"), F.lit(60)) + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"))
    got = mix_sources(docs).cache()
    by = got.groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.first("source_size").alias("s")).collect()
    assert all(abs(r.t - r.g) <= 130 for r in by) and all(r.g <= 2 * r.s + 1e-6 for r in by)
    assert sum(r.g for r in by) == pytest.approx(1.5 * sum(r.s for r in by))
    assert got.where("taken > 2 * size").count() == 0
    assert sorted(got.collect()) == sorted(mix_sources(docs.repartition(7)).collect())


@pytest.mark.parametrize("names", [("_at", "_rank", "_key"), ("_class", "_salt", "Size")])
def test_mixture_keeps_columns_of_any_name(docs, names):
    plain = Counter(tuple(r) for r in mix_sources(docs).select("doc_id", "size", "source_size", "target", "taken").collect())
    got = mix_sources(docs.withColumns({n: F.col("doc_id") + 1 for n in names}))
    assert set(names) - {"Size"} <= set(got.columns)
    assert Counter(tuple(r) for r in got.select("doc_id", "size", "source_size", "target", "taken").collect()) == plain
    assert got.where(f"{names[0]} <=> doc_id + 1").count() == got.count()


def test_mixture_orders_texts_of_one_id(spark):
    rows = [(1, f"{w} {w}", "s", k) for k, w in enumerate("abcdefghij" * 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, k long")
    once = {tuple(sorted((r.text, r.copies) for r in mix_sources(docs.orderBy(F.rand(k)).repartition(k + 1)).collect())) for k in range(3)}
    assert len(once) == 1


def test_mixture_of_nothing(empty):
    assert mix_sources(empty).count() == 0


# -- 1


def plain_lines(rows, least=2, long=200):
    once = {(d is not None, d or 0, t): [x for x in (t or "").split("\n") if SPACE.search(x)] for d, t in rows}
    order = sorted(once, key=lambda k: k[:2])
    first = {}
    for k in order:
        ls = once[k]
        for i in range(len(ls)):
            for h in (1, least):
                if i + h <= len(ls):
                    first.setdefault(tuple(ls[i : i + h]), (k, i))
    out = []
    for d, t in rows:
        k = (d is not None, d or 0, t)
        ls, gone = once[k], set()
        for i in range(len(ls)):
            for h in (1, least):
                run = tuple(ls[i : i + h])
                if len(run) == h and (h == least or len(run[0]) >= long) and first[run] != (k, i):
                    gone |= set(range(i, i + h))
        kept = t if not gone else "\n".join(x for i, x in enumerate(ls) if i not in gone)
        out.append((d, len(ls), len(gone), kept))
    return out


def test_line_dedup(docs, rows):
    got = line_dedup(docs.withColumn("n_lines", F.lit("clash"))).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == Counter(plain_lines([r[:2] for r in rows]))


def plain_longest(rows, least=2):
    """For each document the largest power of two of lines that it shares, in a row, with an earlier place."""
    once = {(d is not None, d or 0, t): [x for x in (t or "").split("\n") if SPACE.search(x)] for d, t in rows}
    out, h = dict.fromkeys(once, 0), least
    while any(len(ls) >= h for ls in once.values()):
        seen = set()
        for k in sorted(once, key=lambda k: k[:2]):
            for i in range(len(once[k]) - h + 1):
                run = tuple(once[k][i : i + h])
                if run in seen:
                    out[k] = h
                seen.add(run)
        h *= 2
    return {k[1]: n for k, n in out.items() if k[0]}


def test_line_dedup_keeps_columns_of_any_name_and_tells_the_longest_run(spark):
    base = [f"line number {k} of it" for k in range(21)]
    rows = [(1, "\n".join(base)), (2, "\n".join(["own", *base[3:14], "end"])), (3, "\n".join(base[:2] + ["x"] + base[4:9])), (4, "alone"), (5, "\n".join(base[:3] * 5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    names = ["_id", "_version", "_lines", "_gone"]
    got = line_dedup(docs.withColumns({n: F.concat(F.lit(n), "doc_id") for n in names})).collect()
    assert all(r[n] == f"{n}{r.doc_id}" for r in got for n in names)
    assert Counter((r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got) == Counter(plain_lines(rows))
    assert {r.doc_id: r.longest_run for r in got} == plain_longest(rows)


def test_line_suffixes_are_intervals_of_a_suffix_array(spark):
    texts = ["a b c d e f", "b c d e x", "c d e f", "a b c d e f", "q"]
    lines = [(d, 0, i, ord(x), 0, False) for d, t in enumerate(texts) for i, x in enumerate(t.split())]
    got = line_suffixes(spark.createDataFrame(lines, "doc_id int, version int, i int, one long, two long, long boolean")).collect()
    seq = {d: t.split() for d, t in enumerate(texts)}
    for h in (1, 2, 4):
        runs = defaultdict(list)
        for d, w in seq.items():
            for i in range(len(w) - h + 1):
                runs[tuple(w[i : i + h])].append((d, i))
        want = {p: r for r, ps in runs.items() if len(ps) > 1 for p in ps}
        level = {(r.doc_id, r.i): r for r in got if r.h == h}
        assert set(level) == set(want)
        ranked = sorted(level, key=lambda p: level[p]["rank"])
        assert [want[p] for p in ranked] == sorted(want.values())
        assert all(level[p]["later"] == (p != min(runs[want[p]])) for p in level)
    assert max(r.h for r in got) == 4


def test_line_dedup_of_nothing(empty):
    assert line_dedup(empty).count() == 0


# -- 6


def plain_jaccard(rows, n=5, percent=80):
    sets = []
    for d, t in rows:
        w = SPACE.findall((t or "").translate(LOWER))
        sets.append((d, {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()))
    parent = {d: d for d, _ in sets if d is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if None not in (a, b) and x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = root(a), root(b)
                parent[max(p, q)] = min(p, q)
    return [(d, len(x), None if d is None else root(d)) for d, x in sets]


@pytest.mark.parametrize("grams, sets, hot", [(1 << 20, 256, 1000), (150, 3, 10)])
def test_jaccard_join(docs, rows, grams, sets, hot, monkeypatch):
    for name, value in (("BLOCK_GRAMS", grams), ("BLOCK_SETS", sets), ("HOT", hot)):
        monkeypatch.setattr(f"lakecover.llm.jaccard.{name}", value)
    got = ngram_jaccard_join(docs.withColumn("digest", F.lit(1)).withColumn("key", F.lit(1)))
    want = Counter(plain_jaccard([r[:2] for r in rows]))
    assert Counter(map(tuple, got.select("doc_id", "n_shingles", "component_id").collect())) == want
    assert Counter(map(tuple, ngram_jaccard_join(docs, links=False).collect())) == want


@pytest.mark.parametrize("percent", [50, 80, 100])
def test_prefix_tree_finds_all_pairs(percent):
    rng = np.random.default_rng(3)
    base = [rng.choice(300, 40, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: 40 - k], 1000 * (i + 1) + np.arange(k) + 50 * j])).astype(np.uint64) for i, b in enumerate(base) for j, k in enumerate((0, 0, 1, 3, 5, 12))]
    want = {(i, j) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= percent * len(np.union1d(sets[i], sets[j]))}
    got = {(max(i, j), min(i, j)) for i, found in similar_pairs(sets, percent) for j in found}
    assert got == want and want


def test_prefix_tree_shares_prefixes():
    seqs = [np.array(x) for x in ([0, 1, 2], [0, 1], [0, 1, 3], [5], [0, 1, 2])]
    tree = PrefixTree(seqs, np.array([3, 2, 3, 1, 3]))
    assert len(tree.roots) == 1 and len(tree.pool) == 5


def test_jaccard_join_of_nothing(empty):
    assert ngram_jaccard_join(empty).count() == 0


# -- 4


@pytest.fixture(scope="module")
def judged(spark):
    rows = [(i, ("the cat sat on the mat and saw the dog " * 5)[: 60 + i], "en" if i % 2 else "fr") for i in range(40)]
    rows += [(100 + i, "zq!x#" * (12 + i), "en") for i in range(5)] + [(200, None, "en"), (201, "", None), (202, "the cat", "xx")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), spark.createDataFrame([(i, 1, 0) for i in range(30)] + [(100, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")


def test_quality_rejects_the_odd_alone(judged):
    docs, labels = judged
    got = {r.doc_id: r for r in quality_scores(docs, labels).collect()}
    assert {d for d, r in got.items() if not r.accepted} == {100, 101, 102, 103, 104}
    assert got[200].perplexity is None and got[202].threshold is not None
    kept = accepted_documents(docs.withColumn("log_p", F.lit(1)), labels)
    assert kept.columns == [*docs.columns, "log_p"] and {r.doc_id for r in kept.collect()} == set(got) - {100, 101, 102, 103, 104}


def plain_kneser_ney(texts, order=5):
    """{context: {byte: p}} by definition, as a function; contexts are tuples, zeros stand before a text."""
    counts = {order: Counter()}
    for t in texts:
        padded = [0] * (order - 1) + list(t.encode())
        counts[order].update(tuple(padded[i : i + order]) for i in range(len(padded) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cuts = {}
    for k, table in counts.items():
        n = [sum(c == i for c in table.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n[:3]) else None
        raw = (1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]) if y else None
        cuts[k] = [min(max(d, 0.05), cap) for d, cap in zip(raw, (0.95, 1.95, 2.95))] if y else [0.5, 1.0, 1.5]
    by_context = {k: defaultdict(dict) for k in counts}
    for k, table in counts.items():
        for g, c in table.items():
            by_context[k][g[:-1]][g[-1]] = c

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / 256
        seen = by_context[k].get(gram[:-1])
        if not seen:
            return lower
        cut = lambda c: cuts[k][min(c, 3) - 1]
        c, total = seen.get(gram[-1], 0), sum(seen.values())
        return ((c - cut(c)) if c else 0) / total + sum(map(cut, seen.values())) / total * lower

    return p


def test_perplexities_against_a_plain_model(judged):
    docs, labels = judged
    rows = docs.selectExpr("doc_id", "text", "lang", "coalesce(xxhash64(text), 0) as version", "cast(pmod(coalesce(xxhash64(text), 0), 2) as int) as fold").collect()
    trusted = {r.doc_id for r in labels.collect() if r.quality == 1}
    models = [plain_kneser_ney([r.text for r in rows if r.doc_id in trusted and r.fold != f]) for f in (0, 1)]
    clash = {c: F.lit("clash") for c in ("_text", "log_p", "log_p_", "n_bytes_", "row", "_row", "part", "fold", "version", "accepted")}
    got = {r.doc_id: r for r in quality_scores(docs.withColumns(clash), labels).collect()}
    adjusted = {}
    for r in rows:
        data = [0] * 4 + list((r.text or "").encode())
        grams = [tuple(data[i : i + 5]) for i in range(len(data) - 4)]
        if not grams:
            assert got[r.doc_id].perplexity is None
            continue
        want = np.exp(-sum(np.log(models[r.fold](g)) for g in grams) / len(grams))
        assert got[r.doc_id].perplexity == pytest.approx(want, rel=1e-5)
    for lang in ("en", "fr"):
        own = sorted(got[r.doc_id].perplexity for r in rows if r.doc_id in trusted and r.lang == lang)
        middle = own[(len(own) + 1) // 2 - 1]
        for r in rows:
            if r.lang == lang and r.text:
                n, x = len(r.text.encode()), got[r.doc_id]
                adjusted[r.doc_id] = np.exp((n * np.log(x.perplexity) + 32 * np.log(middle)) / (n + 32))
                assert x.adjusted == pytest.approx(adjusted[r.doc_id])
        top = sorted(adjusted[r.doc_id] for r in rows if r.doc_id in trusted and r.lang == lang)
        limit = top[int(np.ceil(0.99 * len(top))) - 1]
        assert all(got[r.doc_id].threshold == pytest.approx(limit) and got[r.doc_id].accepted == (adjusted[r.doc_id] <= limit * (1 + 1e-9)) for r in rows if r.lang == lang and r.text)


def test_quality_of_repeated_long_and_clashing_rows(spark, judged):
    docs, labels = judged
    clash = {c: F.lit("clash") for c in ("_text", "log_p_", "n_bytes_", "row", "_row", "part", "fold", "version", "accepted")}
    long = spark.createDataFrame([(500, "the cat sat on the mat and saw the dog " * 10_000, "en")], docs.schema)
    more = docs.unionByName(docs.where("doc_id < 3")).unionByName(docs.where("doc_id = 1")).unionByName(long).unionByName(spark.createDataFrame([(None, "the cat sat on the mat and saw the dog " * 3, "en"), (None, "zq!x#" * 30, "en")], docs.schema))
    kept = accepted_documents(more.withColumns(clash), labels)
    assert kept.columns == [*docs.columns, *clash]
    n = Counter(r.doc_id for r in kept.collect())
    assert n[0] == 2 and n[1] == 3 and n[500] == 1 and n[None] == 1 and n[100] == 0


def test_model_probabilities_sum_to_one(spark, judged):
    from lakecover.llm.quality import ORDER, count_grams, gram_scores, kneser_ney

    docs, _ = judged
    counts = count_grams(docs.where("doc_id < 40").withColumn("fold", F.lit(0)))
    model = kneser_ney(counts.select("gram", "c")).withColumn("fold", F.lit(0))
    heads = [int.from_bytes(context, "big") << 8 for context in (b"the ", b"cat ", b"qqqq", b"\0\0\0\0")]
    asked = spark.createDataFrame([(n, h + b) for n, h in enumerate(heads) for b in range(256)], "n int, key long")
    sums = gram_scores(asked, model).groupBy("n").agg(F.sum(F.exp("log_p")).alias("p")).collect()
    assert len(sums) == 4 and all(r.p == pytest.approx(1.0, abs=1e-6) for r in sums)
    assert ORDER == 5 and discounts([0, 0, 0, 0]) == [0.5, 1.0, 1.5]


def test_quality_without_trust(judged, spark, empty):
    docs, labels = judged
    assert quality_scores(docs, labels.where("false")).where("not accepted").count() == 0
    assert quality_scores(empty, labels).count() == 0


# -- 5


def test_toxicity_learns_and_holds_out(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(600):
        w = [f"w{k}" for k in rng.integers(0, 300, 40)]
        bad = i % 6 == 0
        if bad:
            w[rng.integers(0, 39)] = "You"
            for p in rng.integers(0, 39, 3):
                w[p] = rng.choice(["Idiot!", "scum", "l0ser"])
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(bad)))
    rows += [(10**6, None), (10**6 + 1, ""), (5, rows[5][1])]
    docs, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([*labels, (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    out = held_out(F.col("doc_id"))
    model = fit_toxicity(docs, lab, usable=~out)
    got = toxicity(docs, model).withColumn("out", out).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    truth = {i: t for i, _, t in labels}
    unseen = [r for r in got if r.out and r.doc_id in truth]
    assert len(unseen) > 80 and sum(r.predicted == truth[r.doc_id] for r in unseen) / len(unseen) > 0.97
    assert all(r.out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_toxicity_of_null_repeated_and_clashing_rows(spark):
    docs = spark.createDataFrame([(k % 40 if k else None, f"plain text {k % 7}" + " you fool" * (k % 3 == 0), 1, k) for k in range(400)], "doc_id long, text string, score int, x long")
    labels = spark.createDataFrame([(k, 0, int(k % 3 == 0)) for k in range(40)] * 2, "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, labels, usable=~held_out(F.col("doc_id")))
    got = toxicity(docs, model).select("*", held_out(F.col("doc_id")).alias("h")).collect()
    assert len(got) == 400 and all(0 <= r.score <= 1 and r.h is not None for r in got) and sum(r.doc_id is None for r in got) == 1


def test_toxicity_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = fit_toxicity(docs, none)
    assert toxicity(docs, model).count() == docs.count() and toxicity(empty, model).count() == 0


def test_trees_and_isotonic():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    trees = BoostedTrees().fit(x, y)
    assert ((trees.margin(x) > 0) == y).mean() > 0.95
    at, p = isotonic(np.array([1.0, 2, 3, 4, 5]), np.array([0.0, 1, 0, 1, 1]))
    assert np.all(np.diff(p) >= 0) and np.interp(2.5, at, p) == pytest.approx(0.5)


# -- 8


PAGES = [(0, "http://www.b.example.com/x?y=1", "<p>" + "a" * 120), (1, "http://a.example.com/", None), (2, None, "short"), (3, "http://a.example.com/", "<p>" + "a" * 120), (4, "bad url\r\nX: 1", "short"), (5, "http://é.example/ü", "é" * 200), (None, "http://a.example.com/", "<p>" + "a" * 120), (3, "http://a.example.com/", "<p>" + "a" * 120)]


def test_archives_round_trip(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    got = archive_pages(pages.withColumn("place", F.lit(1))).collect()
    first, want = {}, []
    for d, _, h in sorted(PAGES, key=lambda x: (x[0] is None, x[0] or 0)):
        if len((h or "").encode()) >= 100:
            first.setdefault(h, d)
    for d, _, h in PAGES:
        low = first.get(h)
        again = low is not None and low != d
        want.append((d, len((h or "").encode()), sha(h or ""), "revisit" if again else "response", low if again else None))
    assert Counter(tuple(r[:5]) for r in got) == Counter(want)


@pytest.mark.parametrize("range_rows", [10**6, 7])
def test_archive_index_is_in_global_order(spark, sample, range_rows, monkeypatch):
    monkeypatch.setattr("lakecover.llm.warc.RANGE_ROWS", range_rows)
    monkeypatch.setattr("lakecover.llm.warc.RUN_ROWS", 5)
    folder = shared_folder(spark)
    pages = spark.read.parquet(f"{sample}/pages.parquet").repartition(3)
    records = read_archives(write_archives(pages, folder), folder)
    index = merge_index(records).orderBy("place").collect()
    keys = [(r.urlkey, r.ts, r.page_id) for r in index]
    assert keys == sorted(keys) and len(keys) == pages.count() and [r.place for r in index] == list(range(len(keys)))
    assert len({r.archive for r in index}) > 3 and lost_revisits(records).count() == 0
    r = index[7]
    with open_shared(folder, f"{r.archive}.warc.gz") as file:
        assert next(records_in(file, r.offset, r.offset + r.length))[2]["WARC-Record-ID"] == f"<urn:page:{r.page_id}>"


def test_archives_are_gzip_files_of_records(spark):
    pages, folder = spark.createDataFrame(PAGES, "page_id long, url string, html string"), shared_folder(spark)
    names = [r.archive for r in write_archives(pages, folder).collect()]
    whole = b"".join(gzip.decompress(open_shared(folder, f"{n}.warc.gz").read()) for n in names)
    assert whole.count(b"WARC/1.1\r\n") == len(PAGES) and whole.count(b"WARC-Type: revisit") == 3
    with pytest.raises(ValueError, match="cut record"):
        list(records_in(pa.BufferReader(gzip.compress(whole[:50])[:-9])))


def test_archives_of_nothing_and_of_clashing_columns(spark):
    schema = "page_id long, url string, html string, _page long, _digest string, first string, salt int, archive string"
    assert archive_pages(spark.createDataFrame([], schema)).count() == 0
    long = "é" * 3_000_000
    got = archive_pages(spark.createDataFrame([(1, "http://a.b/", long, 5, "x", "y", 3, "z"), (2, "http://a.b/", long, 5, "x", "y", 3, "z")], schema)).orderBy("page_id").collect()
    assert [(r.payload_bytes, r.record_type, r.refers_to) for r in got] == [(6_000_000, "response", None), (6_000_000, "revisit", 1)]


@pytest.mark.parametrize("runs", [[], [[]], [[1]], [[1, 4, 9], [2, 3], [], [0, 9, 10], [5]]])
def test_loser_tree(runs):
    assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("http://www.b.example.com:80/x?y=1") == "com,example,b)/x?y=1"
    assert url_key("http://a.example.com") == "com,example,a)/"


# -- 10


def plain_media(text):
    raw = (text or "").encode()
    p = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
    means = [sum(p[k * len(p) // 64 : (k + 1) * len(p) // 64]) / (len(p) // 64) for k in range(64)]
    middle = (sorted(means)[31] + sorted(means)[32]) / 2
    bits = "".join("1" if m > middle else "0" for m in means)
    return len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]), f"{int(bits, 2):016x}"


def test_media_table(docs, rows, spark):
    folder = shared_folder(spark)
    got = media_table(docs.withColumn("feature", F.lit("clash")).withColumn("ref", F.lit("clash")), folder).collect()
    want = Counter((d, *plain_media(t)) for d, t, *_ in rows)
    assert Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.feature) for r in got) == want
    texts = {d: t or "" for d, t, *_ in rows}
    by = defaultdict(set)
    for r in got:
        if r.doc_id is not None:
            by[texts[r.doc_id]].add((r.media_sha256, r.media_bytes, r.feature, r.shard, r.offset, r.length))
        stored = open_shared(folder, f"{r.shard}.tar").read_at(r.length, r.offset)
        assert hashlib.sha256(stored).hexdigest() == r.media_sha256 == r.digest and len(stored) == r.media_bytes == r.length
    assert all(len(x) == 1 for x in by.values())
    assert all(r.width * r.height == r.payload_bytes for r in got)


def png_samples(image):
    at, packed = 8, b""
    while at < len(image):
        size, kind = int.from_bytes(image[at : at + 4]), image[at + 4 : at + 8]
        assert int.from_bytes(image[at + 8 + size : at + 12 + size]) == zlib.crc32(image[at + 4 : at + 8 + size])
        packed += image[at + 8 : at + 8 + size] if kind == b"IDAT" else b""
        at += 12 + size
    width, raw = int.from_bytes(image[16:20]), zlib.decompress(packed)
    assert not any(raw[:: width + 1])
    return b"".join(raw[k + 1 : k + 1 + width] for k in range(0, len(raw), width + 1))


@pytest.mark.parametrize("shard_bytes", [1 << 25, 4000])
def test_shards_are_tar_files(docs, rows, spark, shard_bytes, monkeypatch):
    monkeypatch.setattr("lakecover.llm.media.SHARD_BYTES", shard_bytes)
    folder = shared_folder(spark)
    members = write_shards(docs, folder)
    held = members.collect()
    texts = Counter(plain_media(t)[2] for _, t, *_ in rows)
    found = Counter()
    for shard in {r.shard for r in held}:
        own = {r.digest: r for r in held if r.shard == shard}
        with tarfile.open(fileobj=io.BytesIO(open_shared(folder, f"{shard}.tar").read())) as tar:
            assert [m.name for m in tar] == [f"{d}.png" for d in own]
            for m in tar.getmembers():
                image = tar.extractfile(m).read()
                assert hashlib.sha256(image).hexdigest() == m.name[:-4] and m.offset_data == own[m.name[:-4]].offset
                found[hashlib.sha256(png_samples(image)).hexdigest()] += len(own[m.name[:-4]].refs)
    assert found == texts and (len({r.shard for r in held}) > 3) == (shard_bytes < 10**6)
    places = canonical_places(members)
    heads = media_columns(places, folder)
    assert all(r.width == 24 and r.bits == 8 for r in heads.collect()) and places.count() == len(texts)
    assert media_features(heads, folder).count() == len(texts)


def test_media_of_nothing(empty):
    assert media_table(empty).count() == 0
