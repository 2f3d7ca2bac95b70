"""The registered queries of these operators, each over its whole table, and
the DuckDB statements of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, fingerprints, langid, licences, linededup, mixing, negatives, neighbours, pages, quality, simhash, substrings, tries
from tessera.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn
    return register


@query("op1_quality_classifier")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score, predicted for every document."""
    docs = table(spark, sf_dir, "documents")
    model = quality.fit_on_labels(docs, table(spark, sf_dir, "labels"), mod=5, rest=0)
    scored = quality.score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id"), 5, 0).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def _sql_canonical(text: str) -> str:
    out = f"lower(coalesce({text}, ''))"
    for pattern, to in licences.SPELLINGS:
        out = f"regexp_replace({out}, '{pattern}', '{to.replace("$", chr(92))}', 'g')"
    out = f"regexp_replace({out}, '{licences.COPYRIGHT_LINE}', '', 'g')"
    return f"trim(regexp_replace({out}, '{licences.NOT_WORD}', ' ', 'g'))"


def _op2_sql() -> str:
    known = ", ".join("('{}', '{}', '{}')".format(a, b, t.replace("'", "''")) for a, b, t in licences.KNOWN)
    return f"""
WITH known_text(license_id, kind, t) AS (VALUES {known}),
known AS (SELECT sha256({_sql_canonical("t")}) AS digest, min(license_id) AS license_id, min(kind) AS kind
          FROM known_text GROUP BY 1),
units AS (SELECT doc_id, 'document' AS scope, coalesce(text, '') AS u FROM documents
          UNION ALL
          SELECT doc_id, 'line', unnest(string_split(text, chr(10))) FROM documents WHERE contains(text, chr(10))),
hits AS (SELECT doc_id, license_id, kind, scope, count(*) AS n_matches
         FROM units JOIN known ON sha256({_sql_canonical("u")}) = digest GROUP BY ALL)
SELECT d.doc_id, license_id, kind, scope, n_matches
FROM (SELECT DISTINCT doc_id FROM documents) d LEFT JOIN hits h ON d.doc_id IS NOT DISTINCT FROM h.doc_id"""


@query("op2_license_scan", _op2_sql())
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, license_id, kind, scope, n_matches for every document."""
    return licences.scan(table(spark, sf_dir, "documents"))


DOMAINS = {"web": [f"src{i}" for i in range(10)], "reference": [f"src{i}" for i in range(10, 15)]}
MIX_LEVELS = ["domain", "lang", "source"]
MIX_WEIGHTS = {"domain": {"web": 5, "reference": 2, "other": 3}, "lang": {"en": 6, "de": 2, "fr": 2, "es": 1},
               "source": {"src0": 1, "src5": 3}}


def with_domain(docs: DataFrame) -> DataFrame:
    """The domain of each source: a fixed grouping, other for the rest."""
    domain = F.lit("other")
    for name, sources in DOMAINS.items():
        domain = F.when(F.col("source").isin(sources), F.lit(name)).otherwise(domain)
    return docs.withColumn("domain", domain)


def mixing_sql(docs: str, levels: list[str], weights: dict, budget: str, epochs: int, out: str, seed: int = 42) -> str:
    """DuckDB twin of ``mixing.mix`` over the relation ``docs``; ``budget`` may use tokens."""
    keys = [f"k{i}" for i in range(len(levels))]
    parts = [f"""toks AS (SELECT *, {", ".join(f"coalesce({n}::VARCHAR, '{mixing.NULL_NODE}') AS {k}" for n, k in zip(levels, keys))},
  coalesce(len(regexp_extract_all(text, '{mixing.WORD}')), 0)::BIGINT AS n_tokens FROM {docs})""",
             f"""leaf AS (SELECT {", ".join(keys)}, sum(n_tokens)::BIGINT AS tokens, (sum(n_tokens) * {epochs})::BIGINT AS capacity
  FROM toks GROUP BY ALL)"""]
    for i, (name, key) in enumerate(zip(levels, keys)):
        done = keys[:i]
        by = f"PARTITION BY {', '.join(done)}" if done else ""
        weight = "CASE " + key + "".join(f" WHEN '{n}' THEN {w}" for n, w in weights[name].items()) + " ELSE 1 END" if weights.get(name) else "1"
        group = ", ".join([*done, key])
        parent = f"({budget.replace('tokens', '(sum(tokens) OVER ())')})::BIGINT" if not done else "parent_budget"
        join = f"JOIN a{i - 1} USING ({', '.join(done)})" if done else ""
        parts.append(f"""n{i} AS (SELECT {group}, sum(tokens)::BIGINT AS tokens, sum(capacity)::BIGINT AS capacity, ({weight})::BIGINT AS w FROM leaf GROUP BY {group}),
m{i} AS (SELECT {group}, w, CASE WHEN w = 0 THEN 0 ELSE capacity END AS capacity, {parent} AS pb FROM n{i} {join}),
o{i} AS (SELECT *, greatest(sum(w) OVER (win ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), 1)::BIGINT AS w_rest,
  greatest(pb - coalesce(sum(capacity) OVER (win ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0)::BIGINT AS lft
  FROM m{i} WINDOW win AS ({by} ORDER BY capacity::DOUBLE / greatest(w, 1), {key})),
f{i} AS (SELECT *, (lft // w_rest) * w >= capacity AS is_full FROM o{i}),
g{i} AS (SELECT *, sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({by})::BIGINT AS fc,
  greatest(sum(CASE WHEN is_full THEN 0 ELSE w END) OVER ({by}), 1)::BIGINT AS ow FROM f{i}),
a{i} AS (SELECT {group}, CASE WHEN is_full THEN capacity ELSE least((greatest(pb - fc, 0) // ow) * w, capacity) END AS parent_budget FROM g{i})""")
    last = len(levels) - 1
    hashed = f"('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':{seed}:' || epoch), 1, 8))::BIGINT"
    parts.append(f"""placed AS (SELECT t.*, epoch, {hashed} AS h FROM toks t, (SELECT unnest(range({epochs}))::INTEGER AS epoch)),
run AS (SELECT p.*, a.parent_budget, sum(n_tokens) OVER (PARTITION BY {", ".join(keys)} ORDER BY epoch, h, doc_id NULLS FIRST, md5(coalesce(text, ''))
  ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM placed p JOIN a{last} a USING ({", ".join(keys)}))""")
    return f"WITH {', '.join(parts)}\nSELECT {out} FROM run WHERE parent_budget > 0 AND upto <= parent_budget"


_DOMAIN_SQL = ("(SELECT *, CASE " + " ".join(f"WHEN source IN ({', '.join(repr(s) for s in sources)}) THEN '{name}'"
                                             for name, sources in DOMAINS.items()) + " ELSE 'other' END AS domain FROM documents)")


@query("op4_source_mixing", mixing_sql(_DOMAIN_SQL, MIX_LEVELS, MIX_WEIGHTS, "tokens // 2", 2,
                                       "doc_id, domain, lang, source, epoch, n_tokens"))
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, domain, lang, source, epoch, n_tokens of the rows taken for half the corpus's tokens."""
    docs = with_domain(table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return mixing.mix(docs, MIX_LEVELS, MIX_WEIGHTS, F.expr("tokens div 2"), epochs=2).drop("text")


@query("op5_simhash_near_dedup")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (hex), component_id for every document."""
    docs = table(spark, sf_dir, "documents")
    got = simhash.near_duplicates(docs, shingle_words=4, max_bits=4, segments=3)
    return got.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op6_byte_bpe")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    ranks = bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    coded = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), ranks), ranks)
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_line_dedup")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text without the repeated blocks, n_removed for every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return linededup.dedup_lines(docs)


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    docs = table(spark, sf_dir, "documents")
    out = quality.held_out(F.col("doc_id"), 4, 2)
    model = langid.fit(docs.where(~out), public_tokenizers.path("piece_bpe_32k.model"))
    return langid.identify(docs.select("doc_id", out.alias("held_out"), "text"), model).drop("text")


@query("op10_fingerprints")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_chars, edited_sha256, both fingerprints and both likenesses for every document."""
    got = fingerprints.compare_neighbours(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                      "fingerprint", "edited_fingerprint", "near_edited", "near_next")


@query("op3_html_extraction")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id, url, text, n_chars for every page."""
    got = pages.extract(table(spark, sf_dir, "pages"))
    return got.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


@query("op9_nearest_neighbours")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, score: 20 neighbours of every 20th id."""
    return neighbours.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


_OP13_SQL = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, pos, array_to_string(w[pos:pos + 19], ' ') AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS pos FROM d)),
again AS (SELECT doc_id, pos, (row_number() OVER (PARTITION BY g ORDER BY doc_id, pos) > 1)::INT AS again FROM win),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM d),
gone AS (SELECT doc_id, word, pos, max(coalesce(again, 0)) OVER (
           PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone
         FROM words LEFT JOIN again USING (doc_id, pos)),
kept AS (SELECT doc_id, sum(gone) AS n, string_agg(word, ' ' ORDER BY pos) FILTER (gone = 0) AS text FROM gone GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)"""


@query("op13_substring_dedup", _OP13_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every document."""
    got = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


#: CRC-32 of the decimal conv_id, bit by bit
_CRC_SQL = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda r, b: list_reduce(list_prepend(xor(r, b), range(8)), lambda v, z: xor(v >> 1, 3988292384::BIGINT * (v & 1)))), 4294967295::BIGINT)"""

_OP12_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
u AS (SELECT conv_id, strlen(text) AS bytes, md5(strlen(role) || ':' || role || text) AS id,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(role) || ':' || role || text)) AS k FROM t),
c AS (SELECT conv_id, conv_id - conv_id % 5 AS base, n, {_CRC_SQL} % 9 AS h FROM (SELECT conv_id, count(*) AS n FROM u GROUP BY ALL)),
r AS (SELECT c.conv_id, k AS d, id, bytes FROM c JOIN u ON u.conv_id = c.base AND k <= h
      UNION ALL
      SELECT c.conv_id, least(c.h, coalesce(b.n, 0)) + k - c.h, id, bytes
      FROM c JOIN u ON u.conv_id = c.conv_id AND k > c.h LEFT JOIN c b ON b.conv_id = c.base),
pre AS (SELECT conv_id, d, bytes, string_agg(id, '') OVER (PARTITION BY conv_id ORDER BY d) AS p FROM r
        UNION ALL SELECT conv_id, 0, 0, '' FROM c),
node AS (SELECT p, max(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, max(bytes) AS bytes,
           string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (d = last) AS ends
         FROM (SELECT *, max(d) OVER (PARTITION BY conv_id) AS last FROM pre) GROUP BY p),
kids AS (SELECT left(p, length(p) - 32) AS p, count(*) AS k FROM node WHERE depth > 0 GROUP BY 1),
sub AS (SELECT left(p, (32 * i)::INT) AS p, sum((k IS NULL)::INT) AS leaves, sum((n - 1) * bytes) AS saved
        FROM (SELECT node.*, k, unnest(range(0, depth + 1)) AS i FROM node LEFT JOIN kids USING (p)) GROUP BY 1)
SELECT node.conv_id, node.depth::BIGINT AS depth, up.conv_id AS parent_conv_id, node.n::BIGINT AS n_convs, coalesce(k, 0)::BIGINT AS n_children,
  leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(coalesce(node.ends, '')) AS ends_sha256
FROM node JOIN sub USING (p) LEFT JOIN kids USING (p)
LEFT JOIN node up ON node.depth > 0 AND up.p = left(node.p, length(node.p) - 32)"""


@query("op12_conversation_trie", _OP12_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for every node of the trie of the rebuilt conversations."""
    seqs = tries.sequences(table(spark, sf_dir, "conversations"), group=F.col("c") - F.col("c") % 5)
    return tries.nodes(tries.rebuilt(seqs, F.crc32(F.col("c").cast("string")) % 9, most=8))


_OP11_SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
             list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id, list_dot_product(a.v, b.v)::BIGINT AS score
      FROM e a JOIN e b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
pos AS (SELECT * FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.vec_id ORDER BY n.score DESC, n.vec_id))::INT AS rank,
  n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM pos p JOIN s n ON n.anchor_id = p.anchor_id AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10"""


@query("op11_hard_negatives", _OP11_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", negatives.integers(F.col("embedding"), 256.0).alias("v"), F.when(
        F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return negatives.mine(rows, F.col("vec_id") % 100 == 0)
