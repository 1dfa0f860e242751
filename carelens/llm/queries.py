"""The registered queries of the operators (production parameters, whole tables) and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from carelens.llm import (bpe, byte_bpe, class_lm, collocations, exact_dedup, host_reputation, language, near_dups, packing, personal_data, spelling,
                          top_k, toxicity)
from carelens.llm.common import LOWER, UPPER, ship

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def register(fn):
    QUERIES[fn.__name__] = fn
    return fn


@register
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_pieces(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@register
def op2_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_inner_products(spark, table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0", 5)


@register
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(spark, table(spark, sf_dir, "documents"))


@register
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_data(spark, table(spark, sf_dir, "documents"))


@register
def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.codec_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@register
def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@register
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register
def op8_class_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_lm.lm_scores(spark, table(spark, sf_dir, "documents"))


@register
def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.near_duplicates(spark, table(spark, sf_dir, "documents"))


@register
def op10_host_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no labels of their own; a row of ``labels`` with a page's number is its outcome:
    bad if the text is toxic or of low quality."""
    labels = table(spark, sf_dir, "labels")
    bad = F.greatest(F.col("toxic"), 1 - F.col("quality")).cast("int")
    return host_reputation.judged_pages(table(spark, sf_dir, "pages"), labels.select(F.col("doc_id").alias("page_id"), bad.alias("bad")))


@register
def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.codec_digests(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_multi_50k.tiktoken"))


@register
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = spelling.word_counts(table(spark, sf_dir, "documents"), damage_every=31)
    return spelling.variant_groups(spark, words)


@register
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(spark, table(spark, sf_dir, "documents"))


def _fold(column: str) -> str:
    return f"translate({column}, '{UPPER}', '{LOWER}')"


def _host_sql() -> str:
    """Rules and the chain of shrunk rates, level by level, as in ``host_reputation``."""
    R = host_reputation
    low, high = R.STRENGTH
    rules = sorted(R.RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in rules]
    rule = " ".join(f"WHEN {f} THEN '{h + p}'" for f, (_, h, p) in zip(fits, rules))
    said = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, rules))
    strength = (f"CASE WHEN rho IS NULL OR isnan(rho) OR rho <= 0 THEN {high} ELSE least({high}, greatest({low}, 1 / rho - 1)) END")
    rho = ("SELECT sum((k - n * prior) ** 2 - n * prior * (1 - prior)) / nullif(sum(n * (n - 1) * prior * (1 - prior)), 0) AS rho FROM ")
    listed = ", ".join(f"'{x}'" for x in R.SECOND_LEVEL)

    def last(n: int) -> str:
        return f"array_to_string(list_slice(l, -least({n}, len(l)), NULL), '.')"

    return f"""
    WITH p AS (
      SELECT page_id, {_fold("regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1)")} AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path FROM pages),
    bad AS (SELECT doc_id AS page_id, max(greatest(toxic, 1 - quality)) AS bad FROM labels
            WHERE toxic IS NOT NULL OR quality IS NOT NULL GROUP BY doc_id),
    counted AS (SELECT host, regexp_replace(host, ':[0-9]*$', '') AS name, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS k
                FROM p LEFT JOIN bad USING (page_id) GROUP BY host),
    labels_of AS (SELECT *, string_split(name, '.') AS l, regexp_matches(name, '^[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+$') AS ip FROM counted),
    hosts AS (SELECT host, n, k, CASE WHEN ip THEN name WHEN two THEN {last(2)} ELSE {last(1)} END AS suffix,
                     CASE WHEN ip THEN name WHEN two THEN {last(3)} ELSE {last(2)} END AS domain
              FROM (SELECT *, {last(2)} IN ({listed}) AS two FROM labels_of)),
    domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
    suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM domains GROUP BY ALL),
    s0 AS (SELECT *, (SELECT sum(k) / nullif(sum(n), 0) FROM suffixes) AS prior FROM suffixes),
    s1 AS (SELECT suffix, (k + m * prior) / (n + m) AS post FROM s0, (SELECT {strength} AS m FROM ({rho} s0))),
    d0 AS (SELECT d.*, s1.post AS prior FROM domains d JOIN s1 USING (suffix)),
    d1 AS (SELECT domain, (k + m * prior) / (n + m) AS post FROM d0, (SELECT {strength} AS m FROM ({rho} d0))),
    h0 AS (SELECT h.*, d1.post AS prior FROM hosts h JOIN d1 USING (domain)),
    h1 AS (SELECT host, n, m, (k + m * prior) / (n + m) AS mean FROM h0, (SELECT {strength} AS m FROM ({rho} h0))),
    judged AS (SELECT host, mean - {R.Z} * sqrt(mean * (1 - mean) / (n + m + 1)) > {R.MAX_BAD} AS blocked FROM h1)
    SELECT page_id, host, path, CASE {rule} END AS rule,
           coalesce(CASE {said} END, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
    FROM p LEFT JOIN judged USING (host)"""


def _spelling_sql() -> str:
    """Crc32 byte by byte with a table made by rule; near words by wildcards and deletions; chains by recursion."""
    return f"""
    WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: xor(c >> 1, 3988292384 * (c & 1)), b)) AS t),
    runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc, unnest(regexp_extract_all({_fold("coalesce(text, '')")}, '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS w
             FROM documents),
    own AS (SELECT doc, w, count(*) AS n FROM runs WHERE length(w) >= 7 GROUP BY ALL),
    coded AS (SELECT w, n, flatten(list_transform(string_split(doc || ':' || w, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT]
                ELSE [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] END)) AS bytes FROM own),
    hashed AS (SELECT w, n, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h FROM coded, crc),
    kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(w, 1, h % length(w)) || substr(w, h % length(w) + 2) ELSE w END AS word, n FROM hashed),
    words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
    places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words),
    parts AS (SELECT word, n, i, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b FROM places),
    met AS (SELECT x.word, y.word AS near FROM parts x JOIN parts y ON x.i = y.i AND x.a = y.a AND x.b = y.b AND x.word <> y.word
            UNION SELECT x.word, w.word FROM parts x JOIN words w ON w.word = x.a || x.b
            UNION SELECT w.word, x.word FROM parts x JOIN words w ON w.word = x.a || x.b),
    best AS (SELECT met.word, count(*) AS n_near, arg_min(near, (-w.n, near)) AS form, max(w.n) AS form_n
             FROM met JOIN words w ON w.word = near GROUP BY met.word),
    chosen AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 10 * w.n THEN form END AS form,
                      CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
    walk(word, here, further) AS (SELECT word, word, form FROM chosen UNION ALL
                                SELECT walk.word, c.word, c.form FROM walk JOIN chosen c ON c.word = walk.further)
    SELECT c.word, c.form, walk.here AS root, c.n, c.n_near, c.form_n FROM chosen c JOIN walk ON walk.word = c.word AND walk.further IS NULL"""


def _collocations_sql() -> str:
    """Every phrase of up to three words counted, scored at both cuts, dropped where a longer one covers it."""
    def grams(k: int) -> str:
        return (f"SELECT lang, array_to_string(g, ' ') AS g, {k} AS k FROM (SELECT lang, unnest(list_transform(range(1, len(w) - {k - 2}), "
                f"lambda i: w[i:i + {k - 1}])) AS g FROM words)")

    return f"""
    WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({_fold("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) AS p FROM documents),
    words AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM pieces),
    totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
    f AS (SELECT lang, g, k, count(*) AS a FROM ({grams(1)} UNION ALL {grams(2)} UNION ALL {grams(3)}) GROUP BY ALL HAVING count(*) >= 10),
    split AS (SELECT *, string_split(g, ' ') AS w FROM f WHERE k > 1),
    cuts AS (SELECT s.lang, s.g, s.k, s.a, l.a AS l, r.a AS r, l.k AS cut, (1000000::HUGEINT * s.a * s.a) // (l.a::HUGEINT * r.a) AS score
             FROM split s JOIN f l ON l.lang = s.lang AND l.k < s.k AND l.g = array_to_string(s.w[1:l.k], ' ')
             JOIN f r ON r.lang = s.lang AND r.k = s.k - l.k AND r.g = array_to_string(s.w[l.k + 1:], ' ')),
    scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, cut) = 1),
    longer AS (SELECT lang, array_to_string(w[1:2], ' ') AS g, a FROM split WHERE k = 3
               UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM split WHERE k = 3),
    most AS (SELECT lang, g, max(a) AS most FROM longer GROUP BY ALL)
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, g) AS rank, g AS phrase, a, l, r, n, score::BIGINT AS score
    FROM scored JOIN totals USING (lang) LEFT JOIN most USING (lang, g) WHERE k = 3 OR most IS NULL OR 100 * most < 50 * a
    QUALIFY rank <= 2000"""


#: DuckDB SQL over the same tables; the other queries are tested against brute force.
ORACLE: dict[str, str] = {
    "op2_top_k": """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
    s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(q.x) = len(c.x))
    SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank, vec_id, score
    FROM s QUALIFY rank <= 5""",
    "op6_exact_dedup": f"""
    WITH d AS (SELECT doc_id, sha256({_fold("coalesce(text, '')")}) AS text_sha256 FROM documents),
    g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)""",
    "op9_near_dups": f"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all({_fold("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (
      SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w),
    flat AS (SELECT doc_id, unnest(s) AS sh FROM sets),
    shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM flat a JOIN flat b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
    links AS (SELECT a, b FROM shared JOIN sets x ON x.doc_id = a JOIN sets y ON y.doc_id = b
              WHERE 100 * n >= 75 * (len(x.s) + len(y.s) - n)),
    edges AS (SELECT a AS u, b AS v FROM links UNION ALL SELECT b, a FROM links),
    reach(doc_id, other) AS (SELECT doc_id, doc_id FROM sets UNION SELECT r.doc_id, e.v FROM reach r JOIN edges e ON e.u = r.other)
    SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.component_id, s.doc_id = r.component_id AS kept
    FROM sets s JOIN (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id) r USING (doc_id)""",
    "op10_host_reputation": _host_sql(),
    "op12_spelling": _spelling_sql(),
    "op13_collocations": _collocations_sql(),
}
