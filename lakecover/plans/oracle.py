"""The catalogue's queries as DuckDB SQL, where SQL can express them."""

from ..functions.kernels import MURMUR_1, MURMUR_2, PROJECT_1, PROJECT_2, SEED_1, SPLITMIX_1, SPLITMIX_2, WY_0, WY_1

ORACLE: dict[str, str] = {}

_MANIFEST = """m AS (
    SELECT doc_id, doc_id::VARCHAR AS accession, lang, source, 'd__' || lang || ';s__' || CASE WHEN doc_id % 17 = 0 THEN '' ELSE source END AS taxonomy FROM documents
), g AS (SELECT *, CASE WHEN taxonomy LIKE '%;s__' THEN taxonomy || '#' || accession ELSE taxonomy END AS grp FROM m)"""

_PAIRS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
pairs AS (
    SELECT a.label, a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id
), near AS (
    SELECT *, acos(greatest(-1.0, least(1.0, cosine))) / pi() AS dist, row_number() OVER (PARTITION BY label, src ORDER BY cosine DESC, dst) AS rank FROM pairs
)"""

_ISOLATION = _PAIRS + """, iso AS (SELECT label, src AS vec_id, avg(dist) AS isolation FROM near WHERE rank <= 10 GROUP BY label, src)"""


def _mad(rows: str, grp: str, value: str, z: str) -> str:
    return f"""ranked AS (SELECT {grp} AS k, {value} AS x, row_number() OVER (PARTITION BY {grp} ORDER BY {value}) - 1 AS r, count(*) OVER (PARTITION BY {grp}) AS n FROM {rows}),
mid AS (SELECT k, max(x) FILTER (r = n // 2) AS med, max(x) FILTER (r = n // 4) AS q1, max(x) FILTER (r = n * 3 // 4) AS q3 FROM ranked GROUP BY k),
dev AS (SELECT k, d, row_number() OVER (PARTITION BY k ORDER BY d) - 1 AS r, count(*) OVER (PARTITION BY k) AS n FROM (SELECT k, abs(x - med) AS d FROM ranked JOIN mid USING (k))),
lim AS (
    SELECT k, CASE WHEN mad > 1e-9 THEN med + {z} * 1.4826 * mad WHEN q3 - q1 > 1e-9 THEN med + {z} * (q3 - q1) ELSE 'infinity'::DOUBLE END AS threshold
    FROM mid JOIN (SELECT k, max(d) FILTER (r = n // 2) AS mad FROM dev GROUP BY k) USING (k)
)"""


_COMPONENTS = """links AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
reach(node, low) AS (
    SELECT DISTINCT a, a FROM links
    UNION
    SELECT l.b, r.low FROM reach r JOIN links l ON l.a = r.node
), comp AS (SELECT node, min(low) AS component FROM reach GROUP BY node)"""

_ANI = "CASE WHEN {d} <= 0 THEN 100 WHEN {d} >= 0.5 THEN 70 ELSE greatest(70, least(100, 100 * pow(2 * cos({d} * pi()) / (1 + cos({d} * pi())), 1.0 / 21))) END"


def ani(d: str) -> str:
    return _ANI.format(d=d)


ORACLE["manifest_group_counts"] = f"WITH {_MANIFEST} SELECT grp AS \"group\", count(*) AS n FROM g GROUP BY grp"

ORACLE["quality_left_join"] = """
SELECT doc_id, 100.0::DOUBLE * quality AS completeness, toxic::DOUBLE AS contamination, coalesce(100.0::DOUBLE * quality - 5 * toxic, 50.0)::DOUBLE AS quality_score
FROM documents LEFT JOIN labels USING (doc_id)"""

ORACLE["quality_coverage_count"] = "SELECT count(*) AS n_with_quality FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)"

ORACLE["selected_groups_semi"] = "SELECT source, lang, count(*) AS n FROM documents WHERE source LIKE '%1' GROUP BY source, lang"

ORACLE["pending_work_anti"] = "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

ORACLE["fail_flag_filter"] = "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"

ORACLE["canonical_keys"] = r"""
SELECT page_id, regexp_replace(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '\.(gz|zst)$', ''), '(_genomic)?\.(fna|fa|fasta)$|_genomic$', '') AS stem,
       page_id::VARCHAR AS canonical, 'g' || page_id AS stripped FROM pages"""

ORACLE["lineage_extract"] = """
SELECT n_nationkey, r_name AS domain, CASE WHEN n_nationkey % 5 = 0 THEN '' ELSE n_name END AS species, n_nationkey % 5 = 0 AS unresolved
FROM nation JOIN region ON n_regionkey = r_regionkey"""

_RUN = """g AS (SELECT lang || ';' || source AS taxonomy, count(*) AS n, avg(n_chars) AS m FROM documents GROUP BY 1),
r AS (SELECT *, CASE WHEN n <= 10 THEN 'singleton' WHEN n <= 20 THEN 'tiny' ELSE 'embedded' END AS method, ceil(n / 4)::BIGINT AS reps, 90 + m / 1000 AS cov, n % 3 AS below FROM g)"""

ORACLE["report_summary"] = f"""
WITH {_RUN} SELECT count(*) AS n_taxa, coalesce(sum(n), 0)::BIGINT AS n_genomes, coalesce(sum(reps), 0)::BIGINT AS n_representatives, round(avg(cov) FILTER (method <> 'singleton'), 6) AS mean_coverage_ani,
coalesce(sum(below) FILTER (method <> 'singleton'), 0)::BIGINT AS below_95, count(*) FILTER (n % 7 = 0) AS n_failed FROM r"""

ORACLE["report_histograms"] = """
WITH s AS (SELECT count(*)::DOUBLE AS n FROM documents GROUP BY lang, source)
SELECT CASE WHEN n < 2 THEN 0 WHEN n < 11 THEN 1 WHEN n < 21 THEN 2 WHEN n < 51 THEN 3 ELSE 4 END::INT AS bucket, count(*) AS n, 'size' AS what FROM s WHERE n BETWEEN 1 AND 1001 GROUP BY 1
UNION ALL
SELECT CASE WHEN p < 900 THEN 0 WHEN p < 1000 THEN 1 WHEN p < 1100 THEN 2 WHEN p < 1500 THEN 3 ELSE 4 END::INT, count(*), 'price' FROM (SELECT p_retailprice AS p FROM part) WHERE p BETWEEN 0 AND 2500 GROUP BY 1"""

ORACLE["topk_groups_sorted"] = """
SELECT taxonomy, sum(n)::BIGINT AS n FROM (
    SELECT c_mktsegment AS taxonomy, c_nationkey, count(*) AS n FROM customer WHERE lower(c_mktsegment) LIKE '%b%' GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 1000
) GROUP BY taxonomy"""

ORACLE["ordered_fetch_with_miss"] = """
SELECT k.doc_id AS ord, k.doc_id * 2 AS doc_id, d.lang, d.doc_id IS NOT NULL AS found FROM documents k LEFT JOIN documents d ON d.doc_id = k.doc_id * 2"""

ORACLE["upsert_merge"] = """
WITH new AS (SELECT s_suppkey * 2 AS s_suppkey, s_nationkey, s_acctbal + 1 AS s_acctbal FROM supplier WHERE s_suppkey % 3 = 0),
merged AS (SELECT s_suppkey, s_nationkey, s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM new) UNION ALL SELECT * FROM new),
more AS (SELECT s_suppkey + 1 AS s_suppkey, s_nationkey, 0.0::DOUBLE AS s_acctbal FROM new),
changed AS (SELECT * FROM merged UNION ALL SELECT * FROM more WHERE s_suppkey NOT IN (SELECT s_suppkey FROM merged))
SELECT s_suppkey, coalesce(n_regionkey + 100, s_nationkey)::INT AS s_nationkey, round(s_acctbal, 6) AS s_acctbal FROM changed LEFT JOIN nation ON n_nationkey = s_suppkey"""

ORACLE["replace_by_group"] = """
WITH l AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2),
new AS (SELECT l_suppkey, l_returnflag, -n AS n FROM l WHERE l_suppkey % 4 = 0 AND l_returnflag = 'R')
SELECT * FROM l WHERE l_suppkey NOT IN (SELECT l_suppkey FROM new) UNION ALL SELECT * FROM new"""

ORACLE["set_difference_reps"] = """
SELECT p.doc_id, p.doc_id IN (SELECT doc_id FROM labels) AS pinned FROM (SELECT min(doc_id) AS doc_id FROM documents GROUP BY lang, source) p
WHERE p.doc_id NOT IN (SELECT min(doc_id) FROM documents GROUP BY lang)"""

ORACLE["group_moments_zscore"] = """
WITH s AS (SELECT lang, avg(n_chars) AS m, stddev_pop(n_chars) AS sp, stddev_samp(n_chars) AS ss FROM documents GROUP BY lang),
z AS (SELECT doc_id, CASE WHEN ss > 1e-9 THEN (n_chars - m) / ss ELSE 0 END AS z, sp FROM documents JOIN s USING (lang))
SELECT doc_id, round(z, 6) AS z, round(sp, 6) AS sd_pop, CASE WHEN abs(z) > 2 THEN 'nn_outlier+size_outlier' ELSE 'nn_outlier' END || CASE WHEN z < -2 THEN ':small_genome' ELSE '' END AS reason FROM z"""

_PERCENTILES = """SELECT {k} AS lang, max(x) FILTER (r = n * 5 // 100) AS p5, max(x) FILTER (r = n * 25 // 100) AS p25, max(x) FILTER (r = n * 75 // 100) AS p75,
max(x) FILTER (r = n * 95 // 100) AS p95, max(x) FILTER (r = n // 2) AS median
FROM (SELECT {k}, {v}::DOUBLE AS x, row_number() OVER (PARTITION BY {k} ORDER BY {v}) - 1 AS r, count(*) OVER (PARTITION BY {k}) AS n FROM {t}) GROUP BY 1"""

ORACLE["upper_median_and_trunc_percentiles"] = _PERCENTILES.format(k="lang", v="n_chars", t="documents") + " UNION ALL " + _PERCENTILES.format(k="l_returnflag", v="l_quantity", t="lineitem")

ORACLE["mad_outliers"] = f"""
WITH {_mad('documents', 'lang', 'n_chars::DOUBLE', '2')}
SELECT doc_id, lang, n_chars::DOUBLE AS n_chars, round(threshold, 6) AS threshold FROM documents JOIN lim ON k = lang WHERE n_chars > threshold"""

ORACLE["ani_jaccard_functions"] = f"""
WITH x AS (SELECT p_partkey, (p_size % 51)::DOUBLE / 50 AS x FROM part), y AS (SELECT *, pow(0.7 + 0.3 * x, 21) / (2 - pow(0.7 + 0.3 * x, 21)) AS j FROM x)
SELECT p_partkey, round(CASE WHEN x <= 0 THEN 70 WHEN x >= 1 THEN 100 ELSE greatest(70, least(100, 100 * pow(2 * x / (1 + x), 1.0 / 21))) END, 6) AS ani,
round(CASE WHEN x <= 0 THEN 0 WHEN x >= 1 THEN 1 ELSE pow(2 * x / (1 + x), 1.0 / 21) END, 6) AS fraction, round({ani('(x / 2)')}, 6) AS distance_ani,
round(j, 6) AS jaccard, round(acos(greatest(-1, least(1, j))) / pi(), 6) AS theta,
round(CASE WHEN x <= 0 THEN 1 WHEN x >= 1 THEN 0 ELSE greatest(0, least(1, -ln(2 * x / (1 + x)) / 21)) END, 6) AS mash FROM y"""

ORACLE["angular_distance_pairs"] = f"WITH {_PAIRS} SELECT label, src AS a, dst AS b, round(dist, 6) AS dist FROM near WHERE src < dst"

ORACLE["knn_topk"] = f"WITH {_PAIRS} SELECT label, src, dst, rank::INT AS rank, round(dist, 6) AS dist FROM near WHERE rank <= 5"

ORACLE["knn_filtered_vector_search"] = f"WITH {_PAIRS} SELECT dst AS vec_id, round(cosine, 6) AS score FROM near WHERE src = 7 ORDER BY cosine DESC, dst LIMIT 10"

ORACLE["isolation_scores"] = f"WITH {_ISOLATION} SELECT vec_id, label, round(isolation, 6) AS isolation FROM iso"

ORACLE["isolation_outliers"] = f"""
WITH {_ISOLATION}, {_mad('iso', 'label', 'isolation', '2')}
SELECT vec_id, label, round(isolation, 6) AS isolation, round(threshold, 6) AS threshold FROM iso JOIN lim ON k = label WHERE isolation > threshold"""

ORACLE["centroid_distance"] = """
WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS d FROM embeddings),
c AS (SELECT label, d, avg(x) AS m FROM x GROUP BY label, d), n AS (SELECT label, sqrt(sum(m * m)) AS norm FROM c GROUP BY label)
SELECT vec_id, label, round(acos(greatest(-1, least(1, sum(x * m) / any_value(norm)))) / pi(), 6) AS centroid_distance FROM x JOIN c USING (label, d) JOIN n USING (label) GROUP BY vec_id, label"""

_CORE = _ISOLATION + ", core AS (SELECT iso.* FROM iso JOIN (SELECT label, avg(isolation) + 2 * stddev_pop(isolation) AS cut FROM iso GROUP BY label) USING (label) WHERE isolation < cut)"

ORACLE["core_filter_mean_2sigma"] = f"WITH {_CORE} SELECT vec_id, label, round(isolation, 6) AS isolation FROM core"

ORACLE["mutual_rank_edges"] = f"""
WITH {_PAIRS} SELECT label, least(src, dst) AS u, greatest(src, dst) AS v, min(rank)::INT AS rank, round(min(dist), 6) AS dist FROM near WHERE rank <= 10 GROUP BY 1, 2, 3"""

ORACLE["connected_components"] = f"""
WITH RECURSIVE {_PAIRS}, close AS (SELECT src, dst FROM near WHERE cosine >= cos(0.45 * pi())), {_COMPONENTS.format(edges='close')}
SELECT vec_id, coalesce(component, vec_id) AS component FROM embeddings LEFT JOIN comp ON node = vec_id"""

ORACLE["radius_join_reps"] = f"WITH {_PAIRS} SELECT label, src, dst, round(dist, 6) AS dist FROM near WHERE src < dst AND cosine >= cos(0.4 * pi())"

ORACLE["fps_batched"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
step(label, vec_id, v, best, rep, pick, picked, round) AS (
    SELECT label, vec_id, v, CASE WHEN vec_id = first_value(vec_id) OVER w THEN greatest(1.0, list_dot_product(v, v)) ELSE list_dot_product(v, first_value(v) OVER w) END,
           first_value(vec_id) OVER w, CASE WHEN row_number() OVER w = 1 THEN 0 END, 1, 0
    FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)
    UNION ALL
    SELECT label, vec_id, v, CASE WHEN own THEN greatest(1.0, best, list_max(dots)) ELSE greatest(best, list_max(dots)) END,
           CASE WHEN own THEN vec_id WHEN list_max(dots) > best THEN fresh[list_position(dots, list_max(dots))].id ELSE rep END,
           CASE WHEN own THEN (picked + place - 1)::INT ELSE pick END, picked + len(fresh)::INT, round + 1
    FROM (
        SELECT *, open AND place <= 16 AS own, list_transform(fresh, lambda x: list_dot_product(v, x.v)) AS dots
        FROM (
            SELECT *, list({'place': place, 'id': vec_id, 'v': v} ORDER BY place) FILTER (open AND place <= 16) OVER (PARTITION BY label) AS fresh
            FROM (SELECT *, row_number() OVER (PARTITION BY label, open ORDER BY best, vec_id) AS place FROM (SELECT *, pick IS NULL AND best <= cos(0.45 * pi()) AS open FROM step))
        )
    ) WHERE len(fresh) > 0
)
SELECT label, vec_id, arg_max(pick, round) AS pick, arg_max(rep, round) AS rep, round(arg_max(best, round), 6) AS cosine FROM step GROUP BY label, vec_id"""

_FIRST = f"first AS (SELECT * FROM embeddings WHERE vec_id IN (SELECT vec_id FROM ({ORACLE['fps_batched']}) WHERE pick IS NOT NULL))"
_ASSIGNED = f"""e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), {_FIRST},
scored AS (
    SELECT e.label, e.vec_id, f.vec_id AS rep, list_dot_product(e.v, f.embedding::DOUBLE[]) AS cosine FROM e JOIN first f ON f.label = e.label
), assigned AS (
    SELECT label, vec_id, rep, CASE WHEN vec_id = rep THEN 0 ELSE acos(greatest(-1, least(1, cosine))) / pi() END AS dist FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, rep) AS k FROM scored) WHERE k = 1
)"""

ORACLE["nearest_rep_assignment"] = f"WITH {_ASSIGNED} SELECT label, vec_id, rep, round(dist, 6) AS dist FROM assigned"

ORACLE["rep_merge_components"] = f"""
WITH RECURSIVE {_PAIRS}, {_FIRST}, top AS (SELECT vec_id FROM first),
close AS (SELECT src, dst FROM near WHERE cosine >= cos(0.42 * pi()) AND src IN (SELECT vec_id FROM top) AND dst IN (SELECT vec_id FROM top)), {_COMPONENTS.format(edges='close')}
SELECT component AS survivor, count(*) AS n FROM comp GROUP BY component"""

ORACLE["coverage_metrics"] = f"""
WITH {_ASSIGNED}, a AS (SELECT *, {ani('dist')} AS ani, row_number() OVER (PARTITION BY label ORDER BY dist) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM assigned),
m AS (SELECT label, any_value(n) AS n, avg(dist) AS mean, max(dist) FILTER (r = n * 5 // 100) AS p5, max(dist) FILTER (r = n * 95 // 100) AS p95,
      count(*) FILTER (ani < 99) AS b99, count(*) FILTER (ani < 98) AS b98, count(*) FILTER (ani < 97) AS b97, count(*) FILTER (ani < 95) AS b95 FROM a GROUP BY label)
SELECT label, n, round({ani('mean')}, 6) AS coverage_mean_ani, round({ani('p95')}, 6) AS coverage_min_ani, round({ani('p5')}, 6) AS coverage_max_ani,
b99 AS coverage_below_99, b98 AS coverage_below_98, b97 AS coverage_below_97, b95 AS coverage_below_95 FROM m"""

ORACLE["coverage_gate"] = f"WITH {_ASSIGNED} SELECT vec_id, round(ani, 6) AS ani FROM (SELECT vec_id, {ani('dist')} AS ani FROM assigned) WHERE ani < 95"

ORACLE["rep_diversity_pairs"] = f"""
WITH {_PAIRS}, {_FIRST}, top AS (SELECT vec_id FROM first),
p AS (SELECT label, dist, row_number() OVER (PARTITION BY label ORDER BY dist) - 1 AS r, count(*) OVER (PARTITION BY label) AS n
      FROM near WHERE src < dst AND src IN (SELECT vec_id FROM top) AND dst IN (SELECT vec_id FROM top)),
m AS (SELECT label, avg(dist) AS mean, any_value(n) AS n, max(dist) FILTER (r = n * 5 // 100) AS p5, max(dist) FILTER (r = n * 95 // 100) AS p95 FROM p GROUP BY label)
SELECT label, round({ani('mean')}, 6) AS diversity_mean_ani, round({ani('p95')}, 6) AS diversity_min_ani, round({ani('p5')}, 6) AS diversity_max_ani, n::INT AS diversity_n_pairs FROM m"""

ORACLE["fps_single"] = """
WITH RECURSIVE e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings),
step(label, vec_id, v, best, pick, round) AS (
    SELECT label, vec_id, v, list_dot_product(v, first_value(v) OVER w), CASE WHEN row_number() OVER w = 1 THEN 0 END, 0 FROM e WINDOW w AS (PARTITION BY label ORDER BY vec_id)
    UNION ALL
    SELECT label, vec_id, v, greatest(best, list_dot_product(v, nv)), CASE WHEN vec_id = nid AND pick IS NULL THEN round + 1 ELSE pick END, round + 1
    FROM (
        SELECT *, first_value(vec_id) OVER w AS nid, first_value(v) OVER w AS nv, first_value(pick IS NULL AND best <= cos(0.45 * pi())) OVER w AS go
        FROM step WINDOW w AS (PARTITION BY label ORDER BY pick IS NOT NULL, best, vec_id)
    ) WHERE go
)
SELECT label, vec_id, min(pick)::INT AS pick FROM step WHERE pick IS NOT NULL GROUP BY label, vec_id"""

_SHINGLES = """(
    SELECT DISTINCT {id}, array_to_string(w[i:i + {last}], ' ') AS shingle
    FROM (SELECT {id}, w, unnest(range(1, len(w) - {last} + 1)) AS i FROM (SELECT {id}, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM {t}) WHERE len(w) > {last})
)"""

ORACLE["kmer_distinct_counts"] = f"SELECT doc_id, count(*) AS n_shingles FROM {_SHINGLES.format(id='doc_id', t='documents', last=2)} GROUP BY doc_id"

ORACLE["containment_search"] = f"""
WITH q AS {_SHINGLES.format(id='item_id', t='benchmark', last=2)}, t AS {_SHINGLES.format(id='doc_id', t='documents', last=2)}, n AS (SELECT item_id, count(*) AS n FROM q GROUP BY item_id)
SELECT item_id, doc_id, common, round(common / n, 6) AS containment FROM (SELECT item_id, doc_id, count(*) AS common FROM q JOIN t USING (shingle) GROUP BY item_id, doc_id) JOIN n USING (item_id) WHERE common / n >= 0.5"""

ORACLE["fixed_and_singleton_routing"] = f"""
WITH {_MANIFEST}, f AS (SELECT DISTINCT grp FROM g WHERE lang = 'de' AND grp LIKE '%s__src1'), s AS (SELECT grp, count(*) AS n FROM g GROUP BY grp),
r AS (SELECT grp, n, CASE WHEN grp IN (SELECT grp FROM f) THEN 'fixed' WHEN n = 1 THEN 'singleton' WHEN n <= 20 THEN 'tiny' WHEN n <= 50 THEN 'exact' ELSE 'embedded' END AS route FROM s)
SELECT route, sum(n)::BIGINT AS n_items, count(*) AS n_groups FROM r GROUP BY route"""

ORACLE["incremental_equals_full"] = """
SELECT concat_ws(';s__', lang, source) AS taxonomy, count(*) AS n_full, count(*) AS n_incremental, count(*) AS n_same, true AS represented FROM documents GROUP BY 1"""

ORACLE["streaming_foreach_upsert"] = """
SELECT user_id, event_id, event_type, round(value, 6) AS value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r FROM events) WHERE r = 1"""


_SIGNED = "(CASE WHEN {h} >= 9223372036854775808 THEN {h}::HUGEINT - 18446744073709551616 ELSE {h}::HUGEINT END)::BIGINT"


def _times(x: str, factor: int) -> str:
    return f"(({x})::UHUGEINT * {factor}::UHUGEINT % 18446744073709551616::UHUGEINT)"


def _shifted(x: str) -> str:
    return f"xor({x}, {x} // {1 << 33}::UHUGEINT)"


ORACLE["minhash_bottom_s"] = f"""
WITH t AS (SELECT doc_id, hex(text) AS x FROM documents WHERE text IS NOT NULL),
w AS (SELECT DISTINCT doc_id, xor(('0x' || substr(x, 2 * i + 1, 16))::UBIGINT::UHUGEINT, {SEED_1}::UHUGEINT) AS a FROM (SELECT doc_id, x, unnest(range(len(x) // 2 - 7)) AS i FROM t)),
b AS (SELECT doc_id, {_times(_shifted('a'), MURMUR_1)} AS b FROM w), c AS (SELECT doc_id, {_times(_shifted('b'), MURMUR_2)} AS c FROM b),
h AS (SELECT doc_id, {_shifted('c')} AS h FROM c), r AS (SELECT doc_id, h, row_number() OVER (PARTITION BY doc_id ORDER BY h) - 1 AS rank FROM h)
SELECT doc_id, rank::INT AS rank, {_SIGNED.format(h='h')} AS hash FROM r WHERE rank < 100"""


def _base_words(rows: str, k: int) -> str:
    """words(id, word): canonical codes of all whole words of the texts of ``rows``; a digit is a null code, which leaves its words null."""
    recent = ", ".join(f"lag(code, {i}) OVER w AS c{i}" for i in range(k))
    forward = " + ".join(f"c{i} * {4**i}" for i in range(k))
    backward = " + ".join(f"(3 - c{i}) * {4 ** (k - 1 - i)}" for i in range(k))
    return f"""points AS (SELECT id, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS p, unnest(range(len(text))) AS i FROM {rows}),
codes AS (SELECT id, i, CASE WHEN p NOT BETWEEN 48 AND 57 THEN p::BIGINT % 4 END AS code FROM points WHERE p <> 10),
recent AS (SELECT id, {recent} FROM codes WINDOW w AS (PARTITION BY id ORDER BY i)),
words AS (SELECT id, least({forward}, {backward}) AS word FROM recent WHERE ({forward}) IS NOT NULL)"""


ORACLE["kmer_words_relational"] = f"""
WITH turns AS (SELECT concat_ws('-', conv_id, turn) AS id, text FROM conversations WHERE text IS NOT NULL), {_base_words('turns', 8)}
SELECT id, count(DISTINCT word) AS n_words FROM words GROUP BY id"""

ORACLE["oph_bins_relational"] = f"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_base_words('d', 21)},
product AS (SELECT id, xor(word::UHUGEINT, {(SEED_1 + WY_0) % (1 << 64)}::UHUGEINT) * xor(word::UHUGEINT, {WY_1}::UHUGEINT) AS p FROM (SELECT DISTINCT id, word FROM words)),
h AS (SELECT id, xor(p // 18446744073709551616::UHUGEINT, p % 18446744073709551616::UHUGEINT) AS h FROM product)
SELECT id AS doc_id, (h * 256::UHUGEINT // 18446744073709551616::UHUGEINT)::BIGINT AS bin, min(h // 4294967296::UHUGEINT)::BIGINT AS low FROM h GROUP BY ALL"""

ORACLE["sketch_store_resume"] = f"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_base_words('d', 15)},
product AS (SELECT id, xor(word::UHUGEINT, {(SEED_1 + WY_0) % (1 << 64)}::UHUGEINT) * xor(word::UHUGEINT, {WY_1}::UHUGEINT) AS p FROM (SELECT DISTINCT id, word FROM words)),
h AS (SELECT id, xor(p // 18446744073709551616::UHUGEINT, p % 18446744073709551616::UHUGEINT) AS h FROM product),
bins AS (SELECT id, count(DISTINCT h * 64::UHUGEINT // 18446744073709551616::UHUGEINT) AS n FROM h GROUP BY id)
SELECT doc_id, coalesce(n, 0)::INT AS n_real_bins, 0::BIGINT AS failed, 0::BIGINT AS done_again FROM documents LEFT JOIN bins ON id = doc_id"""

ORACLE["kmers_in_sql"] = f"""
WITH d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL), {_base_words('d', 15)},
n AS (SELECT lang, id, count(DISTINCT word) AS n_words FROM words JOIN documents ON doc_id = id GROUP BY lang, id),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n_words) - 1 AS r, count(*) OVER (PARTITION BY lang) AS n_docs, min(n_words) OVER (PARTITION BY lang) / max(n_words) OVER (PARTITION BY lang) AS j FROM n)
SELECT lang, any_value(n_docs) AS n_docs, sum(n_words)::BIGINT AS n_words, max(n_words) FILTER (r = n_docs // 2)::DOUBLE AS median,
       round(CASE WHEN any_value(j) >= 1 THEN 100 ELSE greatest(70, least(100, 100 * pow(2 * any_value(j) / (1 + any_value(j)), 1.0 / 15))) END, 6) AS ani FROM r GROUP BY lang"""

ORACLE["streaming_last_row_state"] = ORACLE["streaming_foreach_upsert"]

ORACLE["tiny_cover"] = """
WITH RECURSIVE d AS (SELECT doc_id, concat_ws(';', lang, source) AS grp, list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS words FROM documents),
small AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY doc_id) AS r FROM d WHERE grp IN (SELECT grp FROM d GROUP BY grp HAVING count(*) <= 20)),
pairs AS (SELECT a.grp, a.r, b.r AS other, len(list_intersect(a.words, b.words)) AS common, len(a.words) + len(b.words) AS sizes FROM small a JOIN small b ON a.grp = b.grp AND b.r < a.r),
covered AS (SELECT grp, r, list(other) AS others FROM pairs WHERE common >= 0.5 * greatest(1, sizes - common) GROUP BY grp, r),
step(grp, r, chosen) AS (
    SELECT grp, r, [r] FROM small WHERE r = 1
    UNION ALL
    SELECT s.grp, n.r, CASE WHEN list_has_any(coalesce(c.others, []), s.chosen) THEN s.chosen ELSE list_append(s.chosen, n.r) END
    FROM step s JOIN small n ON n.grp = s.grp AND n.r = s.r + 1 LEFT JOIN covered c ON c.grp = n.grp AND c.r = n.r
),
last AS (SELECT grp, arg_max(chosen, r) AS chosen FROM step GROUP BY grp),
picked AS (SELECT grp, unnest(chosen) AS r, unnest(range(len(chosen))) AS pick FROM last)
SELECT grp, doc_id, pick::INT AS pick FROM picked JOIN small USING (grp, r)"""

_CELLS = """e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, ('0x' || substr(md5(vec_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS h FROM embeddings),
s AS (SELECT count(*)::DOUBLE AS n, min(h) AS low FROM e),
c AS (SELECT vec_id AS cell, v AS cv FROM e, s WHERE h <= greatest(2.0 * sqrt(n) / n, low)),
to_cells AS (SELECT vec_id, cell, cosine, row_number() OVER (PARTITION BY vec_id ORDER BY cosine DESC, cell) AS place FROM (SELECT vec_id, cell, list_dot_product(v, cv) AS cosine FROM e, c)),
own AS (SELECT vec_id, cell, acos(greatest(-1.0, least(1.0, cosine))) / pi() AS d FROM to_cells WHERE place = 1)"""
_EXACT = """pairs AS (SELECT a.vec_id AS src, b.vec_id AS dst, list_dot_product(a.v, b.v) AS cosine FROM e a JOIN e b ON a.vec_id <> b.vec_id),
exact AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY cosine DESC, dst) AS rank FROM pairs) WHERE rank <= 5),
asks AS (
    SELECT quantile_disc(t.place, 0.95) AS probes FROM exact x JOIN e q ON q.vec_id = x.src JOIN s ON q.h <= greatest(200.0 / n, low)
    JOIN own o ON o.vec_id = x.dst JOIN to_cells t ON t.vec_id = x.src AND t.cell = o.cell
)"""
_FOUND = """found AS (
    SELECT * FROM (
        SELECT p.src, p.dst, p.cosine, row_number() OVER (PARTITION BY p.src ORDER BY p.cosine DESC, p.dst) AS rank
        FROM pairs p JOIN own o ON o.vec_id = p.dst JOIN to_cells t ON t.vec_id = p.src AND t.cell = o.cell JOIN asks ON t.place <= probes {where}
    ) WHERE rank <= 5
)"""
_ANGLE = "round(acos(greatest(-1.0, least(1.0, cosine))) / pi(), 6)"

ORACLE["ann_cells"] = f"""
WITH {_CELLS} SELECT vec_id, cell, count(*) OVER (PARTITION BY cell) AS n, round(max(d) OVER (PARTITION BY cell), 6) AS radius FROM own"""

ORACLE["ann_knn"] = f"WITH {_CELLS}, {_EXACT}, {_FOUND.format(where='')} SELECT src, dst, rank::INT AS rank, {_ANGLE} AS dist FROM found"

ORACLE["ann_filtered"] = f"WITH {_CELLS}, {_EXACT}, {_FOUND.format(where='WHERE p.dst % 2 = 0')} SELECT src, dst, rank::INT AS rank, {_ANGLE} AS dist FROM found"

ORACLE["ann_recall"] = f"""
WITH {_CELLS}, {_EXACT}, {_FOUND.format(where='')},
hits AS (SELECT label, f.dst IS NOT NULL AS hit FROM exact x LEFT JOIN found f ON f.src = x.src AND f.dst = x.dst JOIN e ON e.vec_id = x.src),
cost AS (SELECT ((SELECT count(*) FROM to_cells) + (SELECT count(*) FROM to_cells t JOIN asks ON place <= probes JOIN own o ON o.cell = t.cell)) / (SELECT n * n FROM s) AS cost)
SELECT label, count(*) AS n_true, count(*) FILTER (hit) AS n_found, round((SELECT avg(hit::INT) FROM hits), 6) AS recall, (SELECT probes FROM asks)::INT AS probes, round((SELECT cost FROM cost), 6) AS cost
FROM hits GROUP BY label"""

ORACLE["ann_radius"] = f"""
WITH {_CELLS}, {_EXACT} SELECT src, dst, {_ANGLE} AS dist FROM pairs WHERE src < dst AND cosine >= cos(0.35 * pi())"""

# Spanning forests by adding edges in order; labels of a graph's nodes are a list, which each joining edge rewrites.
# Takes node(label, vec_id, at) and links(label, rung, a, b, w); gives tree(label, rung, a, b, w, side), side the smaller of the joined.
_FORESTS = """ordered AS (
    SELECT l.*, x.at AS u, y.at AS v, row_number() OVER (PARTITION BY l.label, rung ORDER BY w, a, b) AS i
    FROM links l JOIN node x ON x.label = l.label AND x.vec_id = a JOIN node y ON y.label = l.label AND y.vec_id = b
), step(label, rung, i, a, b, w, joined, side, labels) AS (
    SELECT label, rung, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, NULL::DOUBLE, false, 0::BIGINT, range(1, n + 1)
    FROM (SELECT DISTINCT label, rung FROM links) JOIN (SELECT label, count(*) AS n FROM node GROUP BY label) USING (label)
    UNION ALL
    SELECT s.label, s.rung, o.i, o.a, o.b, o.w, s.labels[o.u] <> s.labels[o.v],
           least(len(list_filter(s.labels, lambda x: x = s.labels[o.u])), len(list_filter(s.labels, lambda x: x = s.labels[o.v]))),
           CASE WHEN s.labels[o.u] = s.labels[o.v] THEN s.labels ELSE list_transform(s.labels, lambda x: CASE WHEN x = s.labels[o.v] THEN s.labels[o.u] ELSE x END) END
    FROM step s JOIN ordered o ON o.label = s.label AND o.rung = s.rung AND o.i = s.i + 1
), tree AS (SELECT label, rung, a, b, w, i, side FROM step WHERE joined)"""

ORACLE["mst_distributed"] = f"""
WITH RECURSIVE {_PAIRS}, node AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS at FROM e),
links AS (SELECT label, 0 AS rung, least(src, dst) AS a, greatest(src, dst) AS b, min(dist) AS w FROM near WHERE rank <= 10 GROUP BY ALL), {_FORESTS}
SELECT a, b, round(w, 6) AS w FROM tree"""

_RUNGS = "(VALUES (1), (2), (3), (4), (6), (8), (12), (16), (20)) r(rung)"  # those of the ladder below 20 neighbours, and 20
_GRAPHS = f"""{_CORE}, node AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS at FROM core),
inner_edges AS (
    SELECT near.label, least(src, dst) AS a, greatest(src, dst) AS b, min(rank) AS rank, min(dist) AS dist
    FROM near JOIN node x ON x.vec_id = src JOIN node y ON y.vec_id = dst WHERE rank <= 20 GROUP BY ALL
), links AS (
    SELECT label, 0 AS rung, a, b, rank::DOUBLE AS w FROM inner_edges UNION ALL SELECT label, rung, a, b, dist FROM inner_edges JOIN {_RUNGS} ON rank <= rung WHERE dist < 1
), {_FORESTS}, size AS (SELECT label, count(*) AS n FROM node GROUP BY label),
conn AS (SELECT label, n, CASE WHEN count(w) = n - 1 THEN max(w)::INT ELSE -1 END AS k_conn FROM size LEFT JOIN tree USING (label) WHERE coalesce(rung, 0) = 0 GROUP BY label, n),
tops AS (SELECT label, rung, max(w) AS top FROM tree WHERE rung > 0 GROUP BY label, rung),
stable AS (
    SELECT label, n, k_conn, min(rung) AS k_stable FROM conn JOIN tops t USING (label) JOIN (SELECT label, top AS reference FROM tops WHERE rung = 20) USING (label)
    WHERE rung >= CASE WHEN k_conn > 0 THEN k_conn ELSE 20 END AND (reference <= 0 OR (top - reference) / reference <= 0.03) GROUP BY label, n, k_conn
), shape AS (
    SELECT label, n, k_conn, k_stable, max(w) AS top, coalesce(max(w) FILTER (place = 2), 0) AS w2, arg_max(side, i) AS side, n - count(*) AS components, count(*) FILTER (w >= 0.8 * largest) AS tail
    FROM (
        SELECT s.*, t.w, t.i, t.side, row_number() OVER (PARTITION BY s.label ORDER BY t.i DESC) AS place, max(t.w) OVER (PARTITION BY s.label) AS largest
        FROM stable s JOIN tree t ON t.label = s.label AND t.rung = s.k_stable
    ) GROUP BY label, n, k_conn, k_stable
)"""

ORACLE["knn_k_conn"] = f"WITH RECURSIVE {_GRAPHS} SELECT label, n AS n_main, k_conn::INT AS k_conn, k_stable::INT AS k_stable, components > 1 AS disconnected FROM shape"

ORACLE["mst_bottleneck"] = f"""
WITH RECURSIVE {_GRAPHS} SELECT label, n AS n_main, round(top, 6) AS mst_max_edge, round(w2, 6) AS mst_w2, side::INT AS bridge_min_side, components::INT AS components,
top > 0 AND side <= 10 AND side / n <= 0.005 AND (tail <= 2 OR (w2 > 1e-9 AND top / w2 >= 1.8)) AS pathological_bridge FROM shape"""


ORACLE["theta_resolution"] = f"""
WITH RECURSIVE {_GRAPHS},
firsts AS (SELECT label, dist, row_number() OVER (PARTITION BY label ORDER BY dist) - 1 AS r, count(*) OVER (PARTITION BY label) AS m FROM near WHERE rank = 1),
tails AS (SELECT label, max(dist) FILTER (r = m * 5 // 100) AS p5, max(dist) FILTER (r = m * 95 // 100) AS p95 FROM firsts GROUP BY label),
told AS (
    SELECT label, p5, greatest(1e-6, least(0.45, CASE WHEN n < 20 OR components > 1 OR top <= 0 OR (side <= 10 AND side / n <= 0.005 AND (tail <= 2 OR (w2 > 1e-9 AND top / w2 >= 1.8))) THEN p95 ELSE top END)) AS theta
    FROM shape JOIN tails USING (label)
)
SELECT label, round(theta, 6) AS theta, round(least(p5, theta / 4), 6) AS least FROM told"""

_ALL = "18446744073709551616::UHUGEINT"


def _splitmix(x: str) -> str:
    """The 64-bit finaliser; each step is bound to a name by a list of one."""
    first = f"list_transform([({x})::UHUGEINT], lambda x: xor(x, x // {1 << 30}::UHUGEINT) * {SPLITMIX_1}::UHUGEINT % {_ALL})"
    second = f"list_transform({first}, lambda y: xor(y, y // {1 << 27}::UHUGEINT) * {SPLITMIX_2}::UHUGEINT % {_ALL})"
    return f"list_transform({second}, lambda z: xor(z, z // {1 << 31}::UHUGEINT))[1]"


def _filled(before: str, t: str) -> str:
    """An empty bin's value from its neighbour's: the upper half of the finaliser of the neighbour's value and the bin's number."""
    return f"({_splitmix(f'xor(({before})::UHUGEINT, ({t})::UHUGEINT)')} // {1 << 32}::UHUGEINT)"


def _signatures(bins: int) -> str:
    """sig(id, n_real_bins, sig): filled 16-bit signatures of words(id, word) for the texts d(id, text); bins filled from the left, then those before the first from the right."""
    left = f"list_reduce(list_transform(lows, lambda v: [v]), lambda a, b: list_append(a, coalesce(b[1], {_filled('a[len(a)]', 'len(a)')})))"
    right = f"list_reverse(list_reduce(list_transform(list_reverse(part), lambda v: [v]), lambda a, b: list_append(a, coalesce(b[1], {_filled('a[len(a)]', f'{bins} - 1 - len(a)')}))))"
    return f"""product AS (SELECT id, xor(word::UHUGEINT, {(SEED_1 + WY_0) % (1 << 64)}::UHUGEINT) * xor(word::UHUGEINT, {WY_1}::UHUGEINT) AS p FROM (SELECT DISTINCT id, word FROM words)),
h AS (SELECT id, xor(p // {_ALL}, p % {_ALL}) AS h FROM product),
minima AS (SELECT id, (h * {bins}::UHUGEINT // {_ALL})::BIGINT AS bin, (min(h // 4294967296::UHUGEINT))::UHUGEINT AS low FROM h GROUP BY ALL),
grid AS (SELECT d.id, list(low ORDER BY t) AS lows, count(low) AS n_real_bins FROM d CROSS JOIN (SELECT unnest(range({bins})) AS t) LEFT JOIN minima m ON m.id = d.id AND m.bin = t GROUP BY d.id),
partly AS (SELECT id, n_real_bins, {left} AS part FROM grid),
sig AS (SELECT id, n_real_bins, list_transform({right}, lambda v: coalesce(v % 65536::UHUGEINT, 65535::UHUGEINT)::INT) AS sig FROM partly)"""


_MD5 = "md5(unhex(list_aggregate(list_transform(sig, lambda v: format('{:02x}{:02x}', v % 256, v // 256)), 'string_agg', '')))"
_TEXTS = "d AS (SELECT doc_id AS id, text FROM documents WHERE text IS NOT NULL)"

ORACLE["oph_sketch_vectorized"] = f"""
WITH {_TEXTS}, {_base_words('d', 21)}, {_signatures(256)}, bases AS (SELECT id, count(code) AS n FROM codes GROUP BY id)
SELECT id AS doc_id, {_MD5} AS signature, coalesce(n, 0)::BIGINT AS genome_length, n_real_bins::INT AS n_real_bins, 0::INT AS n_contigs FROM sig LEFT JOIN bases USING (id)"""

ORACLE["oph_jaccard_pairs"] = f"""
WITH {_TEXTS}, {_base_words('d', 21)}, {_signatures(256)}, named AS (SELECT id, sig, concat_ws(';', lang, source) AS grp FROM sig JOIN documents ON doc_id = id),
pairs AS (SELECT a.grp, a.id AS a, b.id AS b, list_sum(list_transform(range(1, 257), lambda t: (a.sig[t] = b.sig[t])::INT)) / 256 AS share FROM named a JOIN named b ON a.grp = b.grp AND a.id < b.id)
SELECT grp, a, b, round(j, 6) AS jaccard FROM (SELECT *, greatest(0, (share - 1.0::DOUBLE / 65536) / (1 - 1.0::DOUBLE / 65536)) AS j FROM pairs) WHERE j > 0.05"""


def _code(k: int) -> str:
    forward, backward = " + ".join(f"c{i} * {4**i}" for i in range(k)), " + ".join(f"(3 - c{i}) * {4 ** (k - 1 - i)}" for i in range(k))
    return f"least({forward}, {backward})"


ORACLE["syncmer_sketch"] = f"""
WITH {_TEXTS}, points AS (SELECT id, unnest(list_transform(string_split(text, ''), lambda x: unicode(x))) AS p, unnest(range(len(text))) AS i FROM d),
codes AS (SELECT id, i, CASE WHEN p NOT BETWEEN 48 AND 57 THEN p::BIGINT % 4 END AS code FROM points WHERE p <> 10),
recent AS (SELECT id, i, {", ".join(f"lag(code, {j}) OVER w AS c{j}" for j in range(21))} FROM codes WINDOW w AS (PARTITION BY id ORDER BY i)),
both_ AS (SELECT id, i, {_code(21)} AS word, xor({_code(11)}, {SEED_1}) AS small FROM recent),
words AS (
    SELECT id, word FROM (
        SELECT id, word, lag(small, 10) OVER w < min(small) OVER (PARTITION BY id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS open FROM both_ WINDOW w AS (PARTITION BY id ORDER BY i)
    ) WHERE open AND word IS NOT NULL
), {_signatures(256)}
SELECT id AS doc_id, {_MD5} AS signature, n_real_bins::INT AS n_real_bins FROM sig"""

_Q = 0.95**21
_LEAST = _Q / (2 - _Q)

ORACLE["derep_tiny_groups"] = f"""
WITH RECURSIVE {_TEXTS}, {_base_words('d', 21)}, {_signatures(128)},
items AS (
    SELECT doc_id::VARCHAR AS accession, concat_ws(';s__', lang, concat_ws('-', source, (n_chars // 400)::VARCHAR)) AS grp, sig, list_transform(lows, lambda v: v IS NOT NULL) AS own, sig.n_real_bins AS filled
    FROM documents JOIN sig ON sig.id = doc_id JOIN grid ON grid.id = doc_id
), small AS (
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY accession) AS r, count(*) OVER (PARTITION BY grp) AS n FROM items) WHERE n <= 20
), pairs AS (
    SELECT a.grp, a.r, b.r AS other, list_sum(list_transform(range(1, 129), lambda t: (a.sig[t] = b.sig[t])::INT)) / 128 AS share,
           list_sum(list_transform(range(1, 129), lambda t: (a.sig[t] = b.sig[t] AND a.own[t])::INT)) / greatest(1, a.filled) AS part, a.filled > 0 AND a.filled < 64 AS sparse
    FROM small a JOIN small b ON a.grp = b.grp AND a.r <> b.r
), alike AS (
    SELECT *, greatest(0, (share - 1.0::DOUBLE / 65536) / (1 - 1.0::DOUBLE / 65536)) AS j FROM pairs
), covered AS (
    SELECT grp, r, list(other) AS others FROM alike WHERE other < r AND CASE WHEN sparse THEN part ELSE j END >= {_LEAST!r}::DOUBLE GROUP BY grp, r
), step(grp, r, chosen) AS (
    SELECT grp, r, [r] FROM small WHERE r = 1
    UNION ALL
    SELECT s.grp, n.r, CASE WHEN list_has_any(coalesce(c.others, []), s.chosen) THEN s.chosen ELSE list_append(s.chosen, n.r) END
    FROM step s JOIN small n ON n.grp = s.grp AND n.r = s.r + 1 LEFT JOIN covered c ON c.grp = n.grp AND c.r = n.r
), last AS (SELECT grp, arg_max(chosen, r) AS chosen FROM step GROUP BY grp),
near AS (
    SELECT a.grp, a.r, a.other, a.j FROM (SELECT alike.*, row_number() OVER (PARTITION BY alike.grp, alike.r ORDER BY j DESC, other) AS place FROM alike JOIN last ON last.grp = alike.grp AND list_contains(chosen, other)) a WHERE place = 1
)
SELECT s.accession, s.grp AS taxonomy, CASE WHEN s.n = 1 THEN 'singleton' ELSE 'tiny' END AS method, list_contains(chosen, s.r) AS representative,
       CASE WHEN list_contains(chosen, s.r) THEN s.accession ELSE o.accession END AS assigned_rep,
       CASE WHEN list_contains(chosen, s.r) THEN 100.0::DOUBLE WHEN x.j > 0 THEN round(greatest(70, least(100, 100 * pow(2 * x.j / (1 + x.j), 1.0 / 21))), 6) ELSE 70 END AS ani_to_rep
FROM small s JOIN last USING (grp) LEFT JOIN near x ON x.grp = s.grp AND x.r = s.r LEFT JOIN small o ON o.grp = x.grp AND o.r = x.other"""

ORACLE["certification"] = f"""
WITH {_TEXTS}, {_base_words('d', 21)}, {_signatures(256)},
items AS (
    SELECT doc_id, lang, sig, list_transform(lows, lambda v: v IS NOT NULL) AS own, sig.n_real_bins AS filled, ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS h
    FROM documents JOIN sig ON sig.id = doc_id JOIN grid ON grid.id = doc_id
), reps AS (SELECT i.* FROM items i JOIN (SELECT lang, count(*)::DOUBLE AS n, min(h) AS low FROM items GROUP BY lang) USING (lang) WHERE h <= greatest(100.0 / n, low)),
pairs AS (
    SELECT a.lang, a.doc_id, b.doc_id AS rep, list_sum(list_transform(range(1, 257), lambda t: (a.sig[t] = b.sig[t])::INT)) / 256 AS share,
           list_sum(list_transform(range(1, 257), lambda t: (a.sig[t] = b.sig[t] AND a.own[t] AND b.own[t])::INT)) / greatest(1, least(a.filled, b.filled)) AS part, least(a.filled, b.filled) AS low, greatest(a.filled, b.filled) AS high
    FROM items a JOIN reps b ON a.lang = b.lang AND a.doc_id <> b.doc_id
), scored AS (SELECT *, greatest(0, (share - 1.0::DOUBLE / 65536) / (1 - 1.0::DOUBLE / 65536)) AS j FROM pairs),
best AS (
    SELECT *, row_number() OVER (PARTITION BY lang, doc_id ORDER BY j DESC, rep) AS place FROM scored WHERE j >= {_LEAST!r}::DOUBLE OR (low > 0 AND 2 * low <= high AND part >= {_Q!r}::DOUBLE)
)
SELECT i.lang, i.doc_id, rep, round(j, 6) AS jaccard FROM items i LEFT JOIN best b ON b.doc_id = i.doc_id AND b.lang = i.lang AND place = 1"""

ORACLE["countsketch_projection"] = f"""
WITH {_TEXTS}, {_base_words('d', 21)}, {_signatures(256)},
each_ AS (SELECT id, unnest(sig)::UHUGEINT AS value, unnest(range(256))::UHUGEINT AS t FROM sig),
votes AS (
    SELECT id, ({_splitmix(f"(value + t * {PROJECT_1}::UHUGEINT % {_ALL}) % {_ALL}")} % 64::UHUGEINT)::INT AS place,
           sum(CASE WHEN {_splitmix(f"(value + t * {PROJECT_2}::UHUGEINT % {_ALL}) % {_ALL}")} % 2::UHUGEINT = 1 THEN 1 ELSE -1 END)::DOUBLE AS x FROM each_ GROUP BY ALL
), vectors AS (SELECT id, place, (x / sqrt(sum(x * x) OVER (PARTITION BY id)))::FLOAT AS x FROM votes),
named AS (SELECT id, sig, concat_ws(';', lang, source) AS grp FROM sig JOIN documents ON doc_id = id),
pairs AS (SELECT a.grp, a.id AS a, b.id AS b, list_sum(list_transform(range(1, 257), lambda t: (a.sig[t] = b.sig[t])::INT)) / 256 AS share FROM named a JOIN named b ON a.grp = b.grp AND a.id < b.id),
alike AS (SELECT * FROM (SELECT *, greatest(0, (share - 1.0::DOUBLE / 65536) / (1 - 1.0::DOUBLE / 65536)) AS j FROM pairs) WHERE j > 0.05)
SELECT grp, a, b, round(j, 6) AS jaccard, round(sum(coalesce(v.x::DOUBLE * w.x::DOUBLE, 0)), 6) AS estimate
FROM alike JOIN vectors v ON v.id = a LEFT JOIN vectors w ON w.id = b AND w.place = v.place GROUP BY grp, a, b, j"""
