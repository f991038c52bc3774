"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lamina.llm import langid, pieces, toxicity
from lamina.llm.chat import digests, format_chats
from lamina.llm.collocations import collocations
from lamina.llm.common import WORD, read
from lamina.llm.decontam import contaminated
from lamina.llm.exact import exact_duplicates
from lamina.llm.lines import without_shared_lines
from lamina.llm.prefixes import conversation_trie
from lamina.llm.quality import held_out, train, with_quality
from lamina.llm.sharding import shard_documents
from lamina.llm.simhash import near_duplicates
from lamina.llm.suffixes import repeated_passages


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.sql("SELECT * FROM VALUES (-1L, 0L, 'user', '</s>[INST] ok [/INST]'), (-1L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digests(format_chats(rows.unionByName(control)))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = with_quality(documents, train(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(read(spark, sf_dir, "documents"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.round_trip(read(spark, sf_dir, "documents")).select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("text", 256).alias("decoded_sha256"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text", "lang", langid.held_out(F.col("doc_id")).alias("held_out"))
    model = langid.train(documents.where("NOT held_out"))
    found = langid.with_language(documents.select("doc_id", "held_out", "text"), *model)
    return found.select("doc_id", "held_out", "language.lang_pred", "language.score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(read(spark, sf_dir, "documents"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(read(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = read(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.with_toxicity(documents, toxicity.train(documents, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


def op12_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(read(spark, sf_dir, "conversations"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = without_shared_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_simhash_near_dedup": op1_simhash_near_dedup,
        "op2_chat_formatting": op2_chat_formatting,
        "op3_quality_classifier": op3_quality_classifier,
        "op4_suffix_array_dedup": op4_suffix_array_dedup,
        "op5_sentencepiece": op5_sentencepiece,
        "op6_language_id": op6_language_id,
        "op7_decontamination": op7_decontamination,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_sharding": op9_sharding,
        "op10_toxicity": op10_toxicity,
        "op11_phrase_collocations": op11_phrase_collocations,
        "op12_conversation_prefix_trie": op12_conversation_prefix_trie,
        "op13_line_dedup": op13_line_dedup,
    }


NORMAL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def oracle_sql() -> dict[str, str]:
    return {
        "op2_chat_formatting": """
            WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
                       UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
            o AS (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS before, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS k FROM c),
            s AS (SELECT *, regexp_replace(text, '([<\\[])(\\\\*)(<ROLE>>|</ROLE>>|<SYS>>|</SYS>>|<END>>|/INST\\]|INST\\]|/s>|s>)', '\\1\\2+\\3', 'g') AS marked FROM o)
            SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
                   coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
                   sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
                   sum(length(marked) + CASE role WHEN 'system' THEN 18 WHEN 'user' THEN 15 WHEN 'assistant' THEN 7 ELSE 25 + length(role) END)::BIGINT AS formatted_chars,
                   coalesce(min('turn ' || k || ': ' || role || ' may not stand here') FILTER (k = bad), CASE WHEN max(bad) IS NULL AND max_by(role, k) <> 'assistant' THEN 'it ends after ' || max_by(role, k) END) AS problem
            FROM (SELECT *, min(k) FILTER (CASE WHEN before IS NULL THEN role NOT IN ('system', 'user') WHEN before IN ('system', 'assistant') THEN role <> 'user' WHEN before = 'user' THEN role <> 'assistant' ELSE true END) OVER (PARTITION BY conv_id) AS bad FROM s)
            GROUP BY conv_id""",
        "op7_decontamination": f"""
            WITH d AS (SELECT doc_id, regexp_extract_all({NORMAL}, '{WORD}') AS w FROM documents),
            i AS (SELECT item_id, regexp_extract_all({NORMAL}, '{WORD}') AS w FROM benchmark),
            ds AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS s FROM d),
            s AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda j: array_to_string(w[j:j + 4], ' '))) AS s FROM i),
            n AS (SELECT item_id, count(*) AS item_shingles FROM s GROUP BY item_id)
            SELECT doc_id, item_id, item_shingles, count(*) AS shared
            FROM ds JOIN s USING (s) JOIN n USING (item_id)
            GROUP BY doc_id, item_id, item_shingles HAVING 5 * count(*) >= 4 * item_shingles""",
        "op8_exact_dedup": f"""
            WITH t AS (SELECT doc_id, {NORMAL} AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   doc_id = max(doc_id) OVER w AS kept, sha256(t) AS text_sha256
            FROM t WINDOW w AS (PARTITION BY t)""",
        "op11_phrase_collocations": rf"""
            WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, regexp_split_to_array({NORMAL}, '[.,;:!?\x0A-\x0D]') AS pieces FROM documents),
            p AS (SELECT i, lang, unnest(pieces) AS piece FROM d),
            w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM p),
            n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
            g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda j: array_to_string(w[j:j + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) v(k)),
            f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 10),
            c AS (SELECT lang, k, phrase, f AS a, unnest(range(1, k)) AS cut, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
            s AS (SELECT c.lang, c.k, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, ((1000000::HUGEINT * c.a * c.a) // (l.f::HUGEINT * r.f))::BIGINT AS score
                  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(w[:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(w[cut + 1:], ' ')),
            b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
            t AS (SELECT lang, f AS longer, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) AS phrase FROM f WHERE k = 3),
            o AS (SELECT b.* FROM b WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.lang = b.lang AND t.phrase = b.phrase AND 100 * t.longer >= 50 * b.a)),
            x AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, score FROM o)
            SELECT x.lang, rank, phrase, a, l, r, n.n, score FROM x JOIN n USING (lang) WHERE rank <= 2000""",
        "op12_conversation_prefix_trie": """
            WITH t AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i, {'r': coalesce(role, ''), 't': coalesce(text, '')} AS x FROM conversations WHERE conv_id IS NOT NULL),
            own AS (SELECT conv_id, list(x ORDER BY i) AS p FROM t GROUP BY conv_id),
            h AS (SELECT conv_id AS c, p, (xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda s: list_prepend(ascii(s)::BIGINT, [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))),
                      lambda a, b: CASE WHEN b >= 0 THEN xor(a, b) ELSE xor(a >> 1, 3988292384::BIGINT * (a & 1)) END), 4294967295::BIGINT) % 9)::INT AS h FROM own),
            r AS (SELECT c, list_concat(coalesce(d.p[:h], []), h.p[h + 1:]) AS p FROM h LEFT JOIN own d ON d.conv_id = c - c % 5),
            m AS (SELECT c, len(p) AS len, unnest(range(0, len(p) + 1)) AS d, p FROM r),
            node AS (SELECT d AS depth, p[:d] AS path, min(c) AS conv_id, count(*) AS n_convs, coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (len = d), '') AS ends, coalesce(strlen(any_value(p[d].t)), 0) AS bytes FROM m GROUP BY d, p[:d]),
            kids AS (SELECT depth - 1 AS depth, path[:depth - 1] AS path, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY ALL),
            full_ AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.depth = n.depth AND k.path = n.path),
            below AS (SELECT a.depth, a.path, count(*) FILTER (b.n_children = 0) AS n_leaves, sum((b.n_convs - 1) * b.bytes)::BIGINT AS saved_tokens FROM full_ a JOIN full_ b ON b.depth >= a.depth AND b.path[:a.depth] = a.path GROUP BY a.depth, a.path)
            SELECT f.conv_id, f.depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, b.n_leaves, b.saved_tokens, sha256(f.ends) AS ends_sha256
            FROM full_ f JOIN below b ON b.depth = f.depth AND b.path = f.path LEFT JOIN full_ u ON u.depth = f.depth - 1 AND u.path = f.path[:f.depth - 1]""",
        "op13_line_dedup": r"""
            WITH d AS (SELECT row_number() OVER () AS i, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
            l AS (SELECT i, doc_id, unnest(lines) AS line, unnest(range(1, len(lines) + 1)) AS pos FROM d),
            k AS (SELECT *, translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
            s AS (SELECT key, min(doc_id) AS keeper FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
            m AS (SELECT k.*, s.keeper IS NOT NULL AND k.doc_id <> s.keeper AS gone FROM k LEFT JOIN s USING (key))
            SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
            FROM m GROUP BY i""",
    }
