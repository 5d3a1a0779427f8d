"""The operators as queries over the given tables, and the whole pipeline."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxcohort.llm.chat_format import preference_pairs
from voxcohort.llm.decontaminate import contaminated
from voxcohort.llm.exact_search import exact_top_k
from voxcohort.llm.filter_audit import audit, failing_ids, words
from voxcohort.llm.html_text import extract_text
from voxcohort.llm.ngram_join import similar_documents
from voxcohort.llm.periodic_runs import periodic_runs
from voxcohort.llm.quality import score_quality
from voxcohort.llm.registry import QUERIES, SQL, query, table
from voxcohort.llm.source_mixing import mix_sources
from voxcohort.llm.suffix_dedup import remove_repeated_bytes
from voxcohort.llm.token_files import coded_tokens
from voxcohort.llm.toxicity import flag_toxic
from voxcohort.llm.substring_dedup import remove_repeated_words


@query("op1_substring_dedup", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
s AS (SELECT doc_id, unnest(range(1, greatest(len(words) - 18, 1))) AS p, words FROM w WHERE len(words) >= 20),
h AS (SELECT doc_id, p, md5(array_to_string(words[p:p + 19], ' ')) AS h FROM s),
r AS (SELECT doc_id, p, row_number() OVER (PARTITION BY h ORDER BY doc_id, p) AS k FROM h),
g AS (SELECT DISTINCT doc_id, p + o AS i FROM r, (SELECT unnest(range(20)) AS o) WHERE k > 1),
gone AS (SELECT doc_id, list(i) AS i FROM g GROUP BY doc_id),
k AS (SELECT w.doc_id, len(words) AS n, coalesce(len(i), 0) AS gone,
  list_filter(words, lambda x, j: NOT list_contains(coalesce(i, []), j)) AS kept FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n AS n_words, gone AS n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM k""")
def op1(spark, sf_dir):
    """Words left in every document after later copies of 20 consecutive words are cut."""
    out = remove_repeated_words(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_words", removed.alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))


@query("op6_suffix_dedup", """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
s AS (SELECT doc_id, x, unnest(range(0, greatest(length(x) // 2 - 399, 0))) AS p FROM d),
h AS (SELECT doc_id, p, md5_number(substring(x, 2 * p + 1, 800)) AS h FROM s),
c AS (SELECT doc_id, p, count(*) OVER (PARTITION BY h) AS k FROM h),
e AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM c WHERE k > 1),
g AS (SELECT doc_id, p, sum(CASE WHEN q IS NULL OR p > q + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS r FROM e),
r AS (SELECT doc_id, r, min(p) AS a, max(p) + 400 AS b FROM g GROUP BY doc_id, r),
k AS (SELECT doc_id, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS z FROM r),
t AS (SELECT d.doc_id, any_value(length(x) // 2) AS n, coalesce(sum(b - a), 0) AS gone, count(a) AS spans,
  coalesce(string_agg(substring(x, 2 * z + 1, 2 * (a - z)), '' ORDER BY a), '') || substring(any_value(x), 2 * coalesce(max(b), 0) + 1) AS kept
  FROM d LEFT JOIN k USING (doc_id) GROUP BY d.doc_id)
SELECT doc_id, n AS n_bytes, CAST(gone AS BIGINT) AS n_removed, spans AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t""")
def op6(spark, sf_dir):
    """Bytes left in every document after all repeated runs of 400 bytes are cut."""
    out = remove_repeated_bytes(table(spark, sf_dir, "documents"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


@query("op9_ngram_join", """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM documents),
p AS (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(words[i:i + 4], ' ')) AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
f AS (SELECT g FROM s GROUP BY g HAVING count(*) > 1),
r AS (SELECT s.doc_id, s.g FROM s JOIN f USING (g)),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM r a JOIN r b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 80 * (x.n + y.n - shared)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
t(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, t.seen FROM t JOIN e ON e.a = t.node),
c AS (SELECT node, min(seen) AS low FROM t GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.low AS component_id FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN c ON c.node = d.doc_id""")
def op9(spark, sf_dir):
    """Number of shingles and component of every document under links of similarity 0.8 or more."""
    return similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query("op3_exact_search", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""")
def op3(spark, sf_dir):
    """The 20 best matches of every twentieth vector among all others."""
    return exact_top_k(table(spark, sf_dir, "embeddings"), lambda key: key % 20 == 0)


@query("op7_source_mixing")
def op7(spark, sf_dir):
    """Words that the mix takes of every document."""
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate")


@query("op8_decontamination")
def op8(spark, sf_dir):
    """Documents that hold a benchmark item, with the edits between them."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_chat_format", """
WITH t AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 AS side, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i,
  coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT pair_id, count(*) FILTER (WHERE side = 0) AS a, count(*) FILTER (WHERE side = 1) AS b FROM t GROUP BY pair_id HAVING a > 0 AND b > 0),
e AS (SELECT x.pair_id, x.i FROM t x JOIN t y ON x.pair_id = y.pair_id AND x.i = y.i AND x.side = 0 AND y.side = 1 AND x.role = y.role AND x.text = y.text),
g AS (SELECT pair_id, i, row_number() OVER (PARTITION BY pair_id ORDER BY i) AS k FROM e),
c AS (SELECT n.pair_id, coalesce(max(k) FILTER (WHERE k = i), 0) AS common FROM n LEFT JOIN g USING (pair_id) GROUP BY n.pair_id),
r AS (SELECT pair_id, side, i, role, i > common AS tail, common, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece FROM t JOIN c USING (pair_id)),
o AS (SELECT *, coalesce(sum(length(piece)) OVER (PARTITION BY pair_id, side, tail ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins FROM r),
z AS (SELECT *, CASE WHEN role = 'assistant' THEN CAST(begins + 14 AS BIGINT) || '-' || CAST(begins + length(piece) - 1 AS BIGINT) END AS span FROM o)
SELECT pair_id, any_value(common) AS prompt_turns,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE side = 0 AND NOT tail), '') AS prompt,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE side = 0 AND tail), '') AS chosen,
  coalesce(string_agg(piece, '' ORDER BY i) FILTER (WHERE side = 1 AND tail), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 0 AND tail), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE side = 1 AND tail), '') AS rejected_mask FROM z GROUP BY pair_id""")
def op10(spark, sf_dir):
    """Conversations 2 n (chosen) and 2 n + 1 (rejected) as prompt and masked completions."""
    key = F.col("conv_id")
    out = preference_pairs(table(spark, sf_dir, "conversations"), F.floor(key / 2), key % 2 == 0)
    mask = lambda name: F.array_join(F.transform(name, lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return out.select("pair_id", F.col("prompt_turns").cast("long").alias("prompt_turns"), "prompt", "chosen", "rejected",
                      mask("chosen_spans").alias("chosen_mask"), mask("rejected_spans").alias("rejected_mask"))


def _fold(n: int):
    return F.crc32(F.col("doc_id").cast("string")) % n


@query("op2_toxicity")
def op2(spark, sf_dir):
    """Toxicity of every document; labels of the fourth whose checksum leaves 2 are not seen."""
    fold = _fold(4)
    out = flag_toxic(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold.isin(0, 1), fold == 3)
    return out.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.3).cast("int").alias("predicted"), "threshold", "flagged")


@query("op4_html_text")
def op4(spark, sf_dir):
    """Main text of every page."""
    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op5_quality")
def op5(spark, sf_dir):
    """Quality of every document; labels of the fifth whose checksum is divisible by 5 are not seen."""
    fold = _fold(5)
    out = score_quality(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"), fold.isin(1, 2, 3), fold == 4)
    return out.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query("op11_filter_audit", """
WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS low FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words FROM d),
l AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS toxic FROM labels GROUP BY doc_id),
m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, CAST(len(words) < 100 AS INTEGER)
  + 2 * CAST(100 * len(list_distinct(words)) < 80 * len(words) AS INTEGER)
  + 4 * CAST(100 * (length(t) - length(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', ''))) > 10 * length(t) AS INTEGER)
  + 8 * CAST(regexp_matches(t, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(low < w.doc_id, false) AS INTEGER) AS fails FROM w LEFT JOIN l USING (doc_id)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, fails),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS name, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.name || b.name || c.name || d.name || e.name AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM f a, f b, f c, f d, f e
  WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS bit, CAST(list_sum(bits[1:step - 1]) AS INTEGER) AS before FROM o, (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, bit,
  coalesce(sum(n) FILTER (WHERE fails & (coalesce(before, 0) | bit) = 0), 0) AS kept,
  coalesce(sum(n) FILTER (WHERE fails & coalesce(before, 0) = 0 AND fails & bit > 0), 0) AS removed,
  coalesce(sum(n) FILTER (WHERE fails & coalesce(before, 0) > 0 AND fails & bit > 0), 0) AS redundant,
  coalesce(sum(n) FILTER (WHERE fails = bit), 0) AS unique_fails,
  coalesce(sum(good) FILTER (WHERE fails & coalesce(before, 0) = 0 AND fails & bit > 0), 0) AS good_lost,
  coalesce(sum(toxic) FILTER (WHERE fails & coalesce(before, 0) = 0 AND fails & bit > 0), 0) AS toxic_lost
  FROM s, c GROUP BY part, filter_order, step, bit, before)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r""")
def op11(spark, sf_dir):
    """Five filters in all 120 orders, by language."""
    return audit(failing_ids(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


@query("op12_periodic_runs", """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS words,
  4294967295 - list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
    lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda c, i: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))) AS h FROM documents),
z AS (SELECT doc_id, words, len(words) AS n, coalesce(h % 10 = 0 AND len(words) > 0, false) AS turned, (h // 10) % greatest(len(words), 1) AS a, 3 + (h // 10) % 8 AS k FROM w),
d AS (SELECT doc_id, n, CASE WHEN turned THEN list_transform(range(n), lambda i: words[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // k) END]) ELSE words END AS words FROM z),
g AS (SELECT doc_id, i, hash(array_to_string(words[i + 1:i + 6], ' ')) AS g FROM (SELECT doc_id, words, unnest(range(0, greatest(n - 5, 0))) AS i FROM d)),
m AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM g x JOIN g y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
t AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS block FROM m),
s AS (SELECT doc_id, min(i) AS s, max(i) - min(i) + 6 + q AS n, q FROM t GROUP BY doc_id, q, block),
r AS (SELECT doc_id, s, n, min(q) AS q FROM s WHERE n >= greatest(12, 2 * q) GROUP BY doc_id, s, n),
c AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS runs, arg_min({'s': s, 'n': n, 'q': q}, {'a': -n, 'b': s, 'c': q}) AS top FROM r GROUP BY doc_id),
x AS (SELECT doc_id, list(DISTINCT i) AS gone FROM (SELECT doc_id, unnest(range(s + q, s + n)) AS i FROM r) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, top.n AS length, top.q AS period, 1000 * top.n // top.q AS exponent_milli, sha256(coalesce(runs, '')) AS runs_sha256,
  sha256(array_to_string(CASE WHEN gone IS NULL THEN words ELSE list_filter(words, lambda x, j: NOT list_contains(gone, j - 1)) END, ' ')) AS collapsed_sha256
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN x USING (doc_id)""")
def op12(spark, sf_dir):
    """Longest run, checksum of all runs and of the collapsed text of every document; a tenth of the documents gets a periodic end."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.crc32(F.col("doc_id").cast("string")).alias("h"),
                                                    words(F.coalesce("text", F.lit(""))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")  # rows without words stay as they are, but numbers are worked out for them too
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    numbers = docs.select("doc_id", "text", "w", ((F.col("h") % 10 == 0) & (n > 0)).alias("turned"), a.alias("a"), p.alias("p"))
    turned = F.array_join(F.transform("w", lambda x, i: F.when(i < F.col("a"), x).otherwise(F.get("w", F.col("a") + (i - F.col("a")) % F.col("p")))), " ")
    out = periodic_runs(numbers.select("doc_id", F.when(F.col("turned"), turned).otherwise(F.col("text")).alias("text")))
    top = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("n"), (-r["start"]).alias("s"), (-r["period"]).alias("q"))))
    line = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.when(F.size("runs") > 0, F.concat(F.array_join(line, "\n"), F.lit("\n"))).otherwise(F.lit(""))
    out = out.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), listed.alias("listed"), "collapsed")
    length, period = F.col("top.n"), -F.col("top.q")
    return out.select("doc_id", "n_runs", (-F.col("top.s")).alias("start"), length.alias("length"), period.alias("period"),
                      F.floor(1000 * length / period).alias("exponent_milli"), F.sha2("listed", 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_token_files")
def op13(spark, sf_dir, tokenizer: str | None = None):
    """Place, number and checksum of every document's token ids, read back from the coded files."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    return coded_tokens(table(spark, sf_dir, "documents"), tokenizer)


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)
