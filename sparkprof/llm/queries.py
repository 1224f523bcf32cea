"""The registered queries of the operators: each applies one to its whole table.

``QUERIES`` maps a name to the query and the SQL that gives the same rows, or None.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkprof.llm import (
    alignment, backoff, chat, decisions, decontaminate, language, licenses, mixing, pages, quality, topk, whitening,
)
from sparkprof.llm.simhash import near_duplicates

# From this score on a document counts as good.
GOOD = 0.7


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def remainder(id: str, parts: int) -> Column:
    """The fold of an id: the checksum of its digits modulo ``parts``; null ids are in none."""
    return F.coalesce(F.crc32(F.col(id).cast("string").cast("binary")) % parts, F.lit(-1))


def op1_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """What the mix takes of each document."""
    drawn = mixing.draws(_table(spark, folder, "documents"))
    return drawn.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.size("mix_draws")).alias("taken"),
        F.col("mix_draws.mix_shard").alias("shards"),
    )


# Control strings as plain text, in a conversation of its own.
_HARD = "</s>[INST] ok [/INST]"


def op2_chat(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one of control strings, formatted; digests read back from the output."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_HARD).alias("text"),
    )
    out = chat.format_conversations(turns.unionByName(hard))
    read = out.withColumn("turns", chat.parse(F.col("formatted"))).withColumn("loss", F.array_join(F.transform(
        "loss_spans",
        lambda s: chat.unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"])),
    ), ""))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_OP2_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
), escaped AS (
  SELECT *, length(regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))
    + length(regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\2\\\3', 'g'))
    + length('<s>[INST][/INST]</s>') AS chars
  FROM turns
), told AS (
  SELECT conv_id, count(*) AS n_turns, CAST(sum(chars) AS BIGINT) AS formatted_chars,
    string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS told,
    coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '') AS loss
  FROM escaped GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(told) AS turns_sha256, length(loss) AS loss_chars,
  sha256(loss) AS loss_sha256, formatted_chars
FROM told
"""


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality of all documents, learned outside the held-out fold."""
    documents, held_out = _table(spark, folder, "documents"), remainder("doc_id", 4) == 2
    model = quality.fit(documents, _table(spark, folder, "labels").filter(~held_out))
    scored = documents.select("doc_id", held_out.alias("held_out"), model.score(F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op4_language(spark: SparkSession, folder: str) -> DataFrame:
    """Languages of all documents, learned outside the held-out fold."""
    documents, held_out = _table(spark, folder, "documents"), remainder("doc_id", 3) == 1
    model = language.fit(documents.filter(~held_out))
    found = documents.select(
        "doc_id", held_out.alias("held_out"), model.predict(F.col("text")).alias("found")
    )
    return found.select("doc_id", "held_out", "found.*")


def op5_backoff(spark: SparkSession, folder: str) -> DataFrame:
    """Language-model scores of all documents."""
    return backoff.score(_table(spark, folder, "documents"))


_OP5_SQL = rf"""
WITH listed AS (
  SELECT row_number() OVER () AS row, doc_id, list_filter(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[ 	-
]+'), lambda w: w <> '') AS words
  FROM documents
), placed AS (
  SELECT row, unnest(words) AS w, generate_subscripts(words, 1) AS place FROM listed
), following AS (
  SELECT *, lag(w) OVER (PARTITION BY row ORDER BY place) AS v FROM placed
), singles AS (SELECT w, count(*) AS n FROM placed GROUP BY w),
pairs AS (SELECT v, w, count(*) AS n FROM following WHERE v IS NOT NULL GROUP BY v, w),
total AS (SELECT greatest(count(*) - 1, 1)::DOUBLE AS others FROM placed),
scored AS (
  SELECT f.row, CASE
      WHEN p.n > 1 THEN (p.n - 1) / greatest(a.n - 1, 1)::DOUBLE
      WHEN f.v IS NULL THEN greatest(b.n - 1, 1) / (SELECT others FROM total)
      ELSE {backoff.BACKOFF}::DOUBLE * (greatest(b.n - 1, 1) / (SELECT others FROM total)) END AS chance
  FROM following f JOIN singles b ON b.w = f.w
    LEFT JOIN singles a ON a.w = f.v LEFT JOIN pairs p ON p.v = f.v AND p.w = f.w
), summed AS (SELECT row, sum(log10(chance)) AS score FROM scored GROUP BY row)
SELECT doc_id, len(words) AS n_words, round(coalesce(score, 0.0), {backoff.DIGITS}) AS score
FROM listed LEFT JOIN summed USING (row)
"""


def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    """Licences of all documents, laid out as files: every hundredth states one for its folder."""
    documents = _table(spark, folder, "documents")
    path = F.expr(
        "concat_ws('/', coalesce(source, 'unknown'), doc_id div 10000, doc_id div 100,"
        " if(doc_id % 100 = 0, 'LICENSE', concat(doc_id, '.txt')))"
    )
    return licenses.scan(documents.select("doc_id", "text", path.alias("path")))


_TEMPLATE_ROWS = ", ".join(
    f"({number}, '{license}', '{word}')"
    for number, (license, text) in enumerate(licenses.TEMPLATES)
    for word in sorted(set(licenses.template_words(text)))
)
_OP6_SQL = rf"""
WITH files AS (
  SELECT doc_id, text, concat_ws('/', coalesce(source, 'unknown'), doc_id // 10000, doc_id // 100,
    CASE WHEN doc_id % 100 = 0 THEN 'LICENSE' ELSE concat(doc_id, '.txt') END) AS path,
    concat_ws('/', coalesce(source, 'unknown'), doc_id // 10000, doc_id // 100) AS dir
  FROM documents
), lines AS (
  SELECT row_number() OVER () AS line, doc_id, path, words FROM (
    SELECT doc_id, path, list_distinct(list_filter(
      regexp_split_to_array(lower(line), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS words
    FROM (SELECT doc_id, path, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM files)
  ) WHERE len(words) > 0
), templates(template, license, word) AS (VALUES {_TEMPLATE_ROWS}),
total AS (SELECT count(*) AS n FROM lines),
seen AS (SELECT word, count(*) AS lines FROM (SELECT unnest(words) AS word FROM lines) GROUP BY word),
weighed AS (
  SELECT template, license, word,
    ln(((SELECT n FROM total) + 1) / CAST(coalesce(lines, 0) + 1 AS DOUBLE)) + 1 AS idf
  FROM templates LEFT JOIN seen USING (word)
), norms AS (
  SELECT template, license, sqrt(sum(idf * idf)) AS norm FROM weighed GROUP BY ALL
), parts AS (
  SELECT line, doc_id, path, n, word, idf
  FROM (SELECT line, doc_id, path, len(words) AS n, unnest(words) AS word FROM lines)
  JOIN (SELECT DISTINCT word, idf FROM weighed) USING (word)
), lengths AS (
  SELECT line, sqrt(sum(idf * idf)
    + (any_value(n) - count(*)) * power(ln((SELECT n FROM total) + 1) + 1, 2)) AS length
  FROM parts GROUP BY line
), shown AS (
  SELECT doc_id, path, license, round(product / norm / length, {licenses.DIGITS}) AS cosine
  FROM (SELECT line, doc_id, path, template, sum(idf * idf) AS product
        FROM parts JOIN (SELECT template, word FROM templates) USING (word) GROUP BY ALL
        HAVING count(*) >= {licenses.SHARED})
  JOIN norms USING (template) JOIN lengths USING (line)
), best AS (
  SELECT * FROM shown WHERE cosine >= {licenses.COSINE}
  QUALIFY row_number() OVER (PARTITION BY doc_id, path ORDER BY cosine DESC, license) = 1
), stated AS (
  SELECT dir, license, cosine FROM best JOIN files USING (doc_id, path) WHERE doc_id % 100 = 0
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY cosine DESC, license) = 1
)
SELECT doc_id, path, coalesce(b.license, s.license) AS license, coalesce(b.cosine, s.cosine) AS cosine,
  CASE WHEN b.license IS NOT NULL THEN 'own' WHEN s.license IS NOT NULL THEN 'inherited' END AS origin,
  CASE WHEN b.license IS NULL AND s.license IS NOT NULL THEN dir END AS license_dir
FROM files LEFT JOIN best b USING (doc_id, path) LEFT JOIN stated s USING (dir)
"""


def op7_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The ten best neighbours of every hundredth vector among all."""
    return topk.top_k(_table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)


_OP7_SQL = """
WITH sound AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) AS BIGINT) AS score
  FROM sound q JOIN sound c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
  WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints and near-duplicate groups of all documents."""
    return near_duplicates(_table(spark, folder, "documents"))


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold benchmark items, with the items."""
    return decontaminate.contaminated(
        _table(spark, folder, "documents"), _table(spark, folder, "benchmark")
    ).drop("run")


_OP9_SQL = rf"""
WITH texts AS (
  SELECT 'doc' AS side, doc_id AS id, text FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT 'item', item_id, text FROM benchmark WHERE item_id IS NOT NULL
), named AS (
  SELECT side, id, lower(regexp_replace(regexp_replace(
    translate(coalesce(text, ''), chr(1) || chr(2), '  '),
    '([^.!?\x09-\x0D ] )(\p{{Lu}}\p{{Ll}}+)', '\1' || chr(1) || 'n\2', 'g'),
    '([0-9])[.,]([0-9])', '\1' || chr(2) || '\2', 'g')) AS text FROM texts
), marked AS (
  SELECT side, id, regexp_replace(regexp_replace(text, '[0-9][0-9\x02]*', chr(1) || 'd\0', 'g'),
    '(\x01d[0-9\x02]+[ -]?)({"|".join(decontaminate.UNITS)})([^\p{{L}}\p{{N}}]|$)',
    '\1 ' || chr(1) || 'u\2\3', 'g') AS text FROM named
), split AS (
  SELECT side, id, list_filter(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}\x01\x02]+'),
    lambda w: w <> '') AS words FROM marked
), lengths AS (
  SELECT DISTINCT least({decontaminate.WINDOW}, len(words)) AS n FROM split
  WHERE side = 'item' AND len(words) > 0
), spans AS (
  SELECT side, id, words, n, unnest(range(1, len(words) - n + 2)) AS place FROM split, lengths
  WHERE len(words) >= n AND (side = 'doc' OR n = least({decontaminate.WINDOW}, len(words)))
), windows AS (
  SELECT side, id, place, n, array_to_string(list_transform(words[place:place + n - 1],
      lambda w: CASE WHEN w[1] = chr(1) THEN w[1:2] ELSE w END), ' ') AS key,
    list_filter(words[place:place + n - 1], lambda w: w[1] = chr(1)) AS slots FROM spans
), kept AS (
  SELECT DISTINCT * FROM windows
  WHERE n - len(slots) >= least({decontaminate.LITERAL}, greatest(n - 1, 1))
), sizes AS (
  SELECT id AS item_id, count(DISTINCT place) AS windows FROM kept WHERE side = 'item' GROUP BY id
), found AS (
  SELECT DISTINCT d.id AS doc_id, i.id AS item_id, d.place AS place, i.place AS item_place,
    d.slots AS given, i.slots AS asked
  FROM kept d JOIN kept i ON d.side = 'doc' AND i.side = 'item' AND d.key = i.key AND d.n = i.n
), slots AS (
  SELECT doc_id, item_id, place, item_place, unnest(asked) AS asked, unnest(given) AS given FROM found
), bound AS (
  SELECT doc_id, item_id, asked, given AS bound FROM (
    SELECT doc_id, item_id, asked, given, count(*) AS n FROM slots GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY doc_id, item_id, asked ORDER BY n DESC, given) = 1
), broken AS (
  SELECT DISTINCT doc_id, item_id, place, item_place FROM slots JOIN bound USING (doc_id, item_id, asked)
  WHERE given <> bound
), pairs AS (
  SELECT doc_id, item_id, count(DISTINCT item_place) AS matched, bool_or(given <> asked) AS changed
  FROM found ANTI JOIN broken USING (doc_id, item_id, place, item_place) GROUP BY ALL
)
SELECT doc_id, item_id, matched, windows, matched / windows::DOUBLE AS share, changed
FROM pairs JOIN sizes USING (item_id) WHERE matched / windows::DOUBLE >= {decontaminate.SHARE}
"""


def op10_pages(spark: SparkSession, folder: str) -> DataFrame:
    """The main text of all pages."""
    return pages.main_text(_table(spark, folder, "pages"))


def op11_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents the base limits and the learned rules keep."""
    return decisions.apply(_table(spark, folder, "documents"), _table(spark, folder, "labels"))


def op12_alignment(spark: SparkSession, folder: str) -> DataFrame:
    """Token alignment of all documents between the byte-level and the piece tokenizer."""
    return alignment.link_counts(_table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """All vectors on their eight leading components, whitened."""
    return whitening.whiten(_table(spark, folder, "embeddings"))


QUERIES = {
    "op1_mixing": (op1_mixing, None),
    "op2_chat": (op2_chat, _OP2_SQL),
    "op3_quality": (op3_quality, None),
    "op4_language": (op4_language, None),
    "op5_backoff": (op5_backoff, _OP5_SQL),
    "op6_licenses": (op6_licenses, _OP6_SQL),
    "op7_topk": (op7_topk, _OP7_SQL),
    "op8_simhash": (op8_simhash, None),
    "op9_decontaminate": (op9_decontaminate, _OP9_SQL),
    "op10_pages": (op10_pages, None),
    "op11_rules": (op11_rules, None),
    "op12_alignment": (op12_alignment, None),
    "op13_whitening": (op13_whitening, None),
}
