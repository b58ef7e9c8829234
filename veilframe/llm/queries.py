"""The registered queries of these operators, with SQL where it can state the result."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..queries import Registry
from .common import shared_folder
from .grammar import read_tokens, write_blocks
from .langid import learn, with_language
from .lines import line_classes
from .merkle import Manifest, proofs
from .mixing import mix
from .neardup import near_duplicates
from .outliers import reject_outliers
from .packing import pack
from .sharding import shard
from .sql import MERKLE_SQL, TRIE_SQL
from .substrings import remove_repeats
from .topk import search
from .toxicity import threshold, train, with_scores
from .trie import trie

REGISTRY = Registry()


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@REGISTRY.add("op1_robust_outliers")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = reject_outliers(table(spark, sf_dir, "documents"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *base, "base_failed", "kept", "distance")


@REGISTRY.add("op2_kd_shards")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"), shards=24)


@REGISTRY.add("op3_repair_tokens")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_blocks(table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"))
    return read_tokens(spark, path)


@REGISTRY.add("op6_packed_windows")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    crc = F.crc32("ids").alias("ids_crc32")
    return pieces.select("doc_id", "start", "length", crc, "doc_tokens", "sequence_id", "offset")


TOP_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score
  FROM vectors q JOIN vectors c ON len(q.v) = len(c.v) AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
"""


@REGISTRY.add("op4_norm_sorted_search", TOP_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@REGISTRY.add("op7_repeated_strings")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"), length=50)
    spans = F.size("starts").cast("long").alias("n_spans")
    return out.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


NEAR_SQL = r"""
WITH RECURSIVE
worded AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s
  FROM worded WHERE w IS NOT NULL),
sized AS (SELECT doc_id, len(s)::BIGINT AS n FROM sets),
shingles AS (SELECT doc_id, unnest(s) AS g FROM sets),
common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n_both
  FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM common JOIN sized x ON x.doc_id = a JOIN sized y ON y.doc_id = b
  WHERE 100 * n_both >= 80 * (x.n + y.n - n_both)),
reach(doc_id, place) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, l.b FROM reach r JOIN links l ON r.place = l.a),
least AS (SELECT doc_id, min(place)::BIGINT AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sized USING (doc_id)
"""


@REGISTRY.add("op8_minhash_near_duplicates", NEAR_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


@REGISTRY.add("op9_line_edit_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_classes(table(spark, sf_dir, "documents")).drop("mark")


def fold(parts: int = 5, key: str = "doc_id") -> Column:
    """The part of the rows, by the crc32 of their id, that nothing is learnt from or all is."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(parts))


@REGISTRY.add("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of texts; ``toxic`` is the verdict by the language's calibrated ``threshold``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs, table(spark, sf_dir, "labels"), fold() != 0)
    scored, score = with_scores(docs, model)
    limit = threshold(model, F.col("lang"))
    return scored.select(
        "doc_id",
        (fold() == 0).alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= 0.5).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col(score) >= limit).alias("toxic"),
    )


MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h
  FROM documents),
totals AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source),
fills AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap FROM totals),
levels AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER (
               ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (
               ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM fills),
targets AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN level * weight <= cap THEN level END) OVER () * weight, cap)) AS target
  FROM levels),
plans AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS passes FROM targets),
classes AS (
  SELECT source, h, sum(size)::BIGINT AS w,
         (sum(sum(size)) OVER (PARTITION BY source ORDER BY h))::BIGINT AS upto
  FROM sized GROUP BY source, h)
SELECT s.doc_id, s.size, p.source_size, p.target,
       (p.passes * s.size + CASE
          WHEN c.upto <= floor(p.target)::BIGINT - p.passes * p.source_size THEN s.size
          WHEN c.upto - c.w < floor(p.target)::BIGINT - p.passes * p.source_size
            THEN (s.size::HUGEINT * (floor(p.target)::BIGINT - p.passes * p.source_size - c.upto + c.w)) // c.w
          ELSE 0 END)::BIGINT AS taken
FROM sized s
JOIN plans p ON s.source IS NOT DISTINCT FROM p.source
JOIN classes c ON s.source IS NOT DISTINCT FROM c.source AND s.h = c.h
"""


@REGISTRY.add("op5_source_mix", MIX_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    out = mix(docs)
    m = F.col("mix")
    return out.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), m["taken"].alias("taken"))


@REGISTRY.add("op11_ppm_language")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    trees = learn(docs, fold(3) != 1)
    found, name = with_language(docs.drop("lang"), trees)
    held = F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out")
    return found.select("doc_id", held, F.col(name)["lang"].alias("lang_pred"), F.col(name)["score"].alias("score"))


@REGISTRY.add("op12_prefix_trie", TRIE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


def edited_documents() -> tuple[dict, Column]:
    """What op13 tampers with: the line ends of documents whose id has an even crc32."""
    even = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(2)) == 0
    return {"text": F.translate("text", "\n", "")}, even


@REGISTRY.add("op13_merkle_manifest", MERKLE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return proofs(Manifest(table(spark, sf_dir, "documents"), *edited_documents()))
