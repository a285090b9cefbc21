"""Conversations, chunking, classification, mutation and layers over the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessellum.functions.text import UNTOUCHED
from tessellum.operators import chunking, conversations, ingest, layers, memories, reader, summary
from tessellum.plans.registry import register
from tessellum.plans.views import CHUNKS, chunks, table


@register("exchange_pairs", "SELECT conv_id, turn, prompt, CASE WHEN nr = 'assistant' THEN nt END AS reply FROM (SELECT conv_id, turn, role, text AS prompt, lead(role) OVER w AS nr, lead(text) OVER w AS nt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def exchange_pairs(spark, sf):
    return conversations.exchange_pairs(table(spark, sf, "conversations"))


@register(
    "transcripts",
    r"SELECT conv_id, regexp_replace(string_agg(line, '' ORDER BY turn), '\n\z', '') AS transcript FROM (SELECT conv_id, turn, CASE WHEN role = 'user' THEN '> ' || text ELSE text END || CASE WHEN role = 'user' AND coalesce(lead(role) OVER (PARTITION BY conv_id ORDER BY turn), '') = 'assistant' THEN chr(10) ELSE chr(10) || chr(10) END AS line FROM conversations) GROUP BY conv_id",
)
def transcripts(spark, sf):
    return conversations.transcript(table(spark, sf, "conversations"))


def _count(words: list[str]) -> str:
    return " + ".join(f"CAST(contains(h, '{w}') AS INT)" for w in words)


_TOPIC = "greatest(" + ", ".join(f"({_count(w)}) * 10 + {9 - k}" for k, w in enumerate(conversations.TOPICS.values())) + ")"


@register(
    "conversation_topic",
    f"WITH t AS (SELECT conv_id, turn, lower(left(text, 3000)) AS h FROM conversations), s AS (SELECT conv_id, turn, {_TOPIC} AS b FROM t) SELECT conv_id, turn, CASE WHEN b < 10 THEN 'general' " + " ".join(f"WHEN b % 10 = {9 - k} THEN '{n}'" for k, n in enumerate(conversations.TOPICS)) + " END AS topic FROM s",
)
def conversation_topic(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", conversations.topic(F.col("text")).alias("topic"))


@register(
    "line_groups_25",
    r"WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents), g AS (SELECT doc_id, k, regexp_replace(array_to_string(x[k:k + 24], chr(10)), '^\s+|\s+$', '', 'g') AS content FROM (SELECT doc_id, x, unnest(range(1, len(x) + 1, 25)) AS k FROM l)) "
    "SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS chunk_index, content FROM g WHERE length(content) > 30",
)
def line_groups_25(spark, sf):
    out = conversations.line_groups(table(spark, sf, "documents"))
    return out.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "content")


def _fold(parts: str, glue: str, n: int) -> str:
    """Neighbours joined while they stay within 2,500 characters."""
    return f"list_reduce(list_transform({parts}, lambda x: [x]), lambda a, x: CASE WHEN a[-1] = '' THEN a[1:-2] || x WHEN length(a[-1]) + length(x[1]) + {n} <= 2500 THEN a[1:-2] || [a[-1] || {glue} || x[1]] ELSE a || x END)"


_STRIPPED = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"


#: The chunks of documents in SQL, as a table ``chunked`` behind WITH.
CHUNKED = (
    r"WITH p AS (SELECT doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '\n\s*\n'), lambda x: " + _STRIPPED.format("x") + "), lambda x: length(x) >= 100) AS p FROM documents), "
    "b AS (SELECT doc_id, unnest(p) AS block, generate_subscripts(p, 1) AS i FROM p), g AS (SELECT *, length(block) > 4000 AS big FROM b), l AS (SELECT *, lag(big) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM g), "
    "k AS (SELECT *, sum(CASE WHEN big OR coalesce(before, FALSE) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS grp FROM l), r AS (SELECT doc_id, grp, bool_or(big) AS big, list(block ORDER BY i) AS blocks FROM k GROUP BY ALL), "
    "f AS (SELECT doc_id, grp, CASE WHEN big THEN " + _fold("string_split(blocks[1], chr(10))", "chr(10)", 1) + " ELSE " + _fold("blocks", "chr(10) || chr(10)", 2) + " END AS chunks FROM r), "
    "c AS (SELECT doc_id, grp, unnest(chunks) AS content, generate_subscripts(chunks, 1) AS j FROM f UNION ALL SELECT doc_id, 0, text, 0 FROM p WHERE len(p) = 0), s AS (SELECT doc_id, grp, j, " + _STRIPPED.format("content") + " AS content FROM c), "
    "chunked AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY grp, j) - 1 AS chunk_index, content FROM s WHERE length(content) >= 100)"
)


@register("chunk_documents", f"{CHUNKED} SELECT doc_id, chunk_index, content FROM chunked")
def chunk_documents(spark, sf):
    return chunking.chunk_column(table(spark, sf, "documents"), ["doc_id"]).withColumn("chunk_index", F.col("chunk_index").cast("long"))


# Segments that are told to events in turn, with the type and confidence that their signs add up to.
_SEGMENTS = [
    ("We decided to use the small parser because it is simple.", "decision", 0.4), ("I prefer tabs and we always use them, never use blanks here.", "preference", 0.8), ("It works now and we finally shipped version 2 of the demo.", "milestone", 1.0),
    ("The bug is a crash and the build keeps failing again.", "problem", 0.8), ("The issue was a broken lock but now it is fixed and resolved.", "milestone", 0.8), ("Nothing of note was said here today at all.", None, None), ("short", None, None),
    ("We chose this strategy today.\n```\nerror bug crash fail error bug crash\n```\nimport error from bug", "decision", 0.4),
]
_SEGMENT_VALUES = ", ".join("({}, {}, {})".format(k, "NULL" if t is None else f"'{t}'", "NULL" if c is None else c) for k, (_, t, c) in enumerate(_SEGMENTS))


@register("memory_types", f"SELECT event_id, t AS memory_type, CAST(c AS DOUBLE) AS confidence FROM events JOIN (VALUES {_SEGMENT_VALUES}) v(k, t, c) ON k = event_id % {len(_SEGMENTS)} WHERE t IS NOT NULL")
def memory_types(spark, sf):
    text = F.element_at(F.array(*[F.lit(x[0]) for x in _SEGMENTS]), (F.col("event_id") % len(_SEGMENTS)).cast("int") + 1)
    return memories.memory_types(table(spark, sf, "events").select("event_id", text.alias("content"))).select("event_id", "memory_type", "confidence")


@register("memory_segments", f"SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS INTEGER) AS chunk_index, t AS memory_type FROM events JOIN (VALUES {_SEGMENT_VALUES}) v(k, t, c) ON k = event_id % 7 WHERE t IS NOT NULL AND k < 7")
def memory_segments(spark, sf):
    """Memories of a user's whole log, whose paragraphs are the segments above."""
    text = F.element_at(F.array(*[F.lit(x[0]) for x in _SEGMENTS]), (F.col("event_id") % 7).cast("int") + 1)
    logs = table(spark, sf, "events").select("user_id", "event_id", text.alias("t")).groupBy("user_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("event_id", "t"))), lambda x: x["t"]), "\n\n").alias("text"))
    return memories.extract_memories(logs, ["user_id"]).select("user_id", "chunk_index", "memory_type")


_STOP = ["the", "and", "for", "with", "that", "this", "from", "was", "are", "not"]
_STOPPED = ", ".join(f"'{w}'" for w in _STOP)


@register(
    "entity_candidates",
    r"WITH x AS (SELECT conv_id, turn, unnest(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+')) AS tok, generate_subscripts(regexp_extract_all(text, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_]+'), 1) AS i FROM conversations), "
    r"c AS (SELECT *, regexp_full_match(tok, '[A-Z][a-z]+') AS cap, regexp_full_match(tok, '\s+') AS ws FROM x), "
    r"l AS (SELECT *, coalesce(lag(cap) OVER w AND ws AND lead(cap) OVER w, FALSE) AS glue FROM c WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)), "
    r"m AS (SELECT *, cap AND NOT coalesce(lag(glue) OVER (PARTITION BY conv_id, turn ORDER BY i), FALSE) AS first FROM l), g AS (SELECT *, sum(CAST(first AS INT)) OVER (PARTITION BY conv_id, turn ORDER BY i) AS run FROM m), "
    r"p AS (SELECT string_agg(tok, '' ORDER BY i) AS name, count(*) AS n, bool_or(lower(tok) IN (" + _STOPPED + r")) AS stopped FROM g WHERE cap OR glue GROUP BY conv_id, turn, run), "
    r"every AS (SELECT name FROM p WHERE n > 1 AND NOT stopped UNION ALL SELECT tok FROM c WHERE regexp_full_match(tok, '[A-Z][a-z]{1,19}') AND lower(tok) NOT IN (" + _STOPPED + ")) "
    "SELECT name, count(*) AS frequency FROM every GROUP BY name HAVING count(*) >= 3",
)
def entity_candidates(spark, sf):
    return memories.name_candidates(table(spark, sf, "conversations"), _STOP)


@register("retention_newest_n", "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) <= 5 AS retained FROM events")
def retention_newest_n(spark, sf):
    return ingest.newest_per_kind(table(spark, sf, "events"), 5, "event_type", "ts", "event_id").select("event_id", "event_type", "retained")


@register(
    "upsert_latest_wins",
    "WITH stored AS (SELECT o_orderkey AS id, o_orderstatus AS v FROM orders), inc AS (SELECT l_orderkey AS id, l_linestatus AS v, l_linenumber AS n FROM lineitem WHERE l_orderkey % 3 = 0), last AS (SELECT id, v FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS k FROM inc) WHERE k = 1) SELECT * FROM stored WHERE id NOT IN (SELECT id FROM inc) UNION ALL SELECT * FROM last",
)
def upsert_latest_wins(spark, sf):
    """Lines of one order may have the same number: of the last ones the first in the file comes in. An order without a key
    stays only if nothing comes in, as with NOT IN."""
    stored = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("v"))
    incoming = table(spark, sf, "lineitem").filter("l_orderkey % 3 = 0").select(F.col("l_orderkey").alias("id"), F.col("l_linestatus").alias("v"), F.col("l_linenumber").alias("n"), F.struct("_metadata.file_path", "_metadata.row_index").alias("place"))
    keyless = stored.filter("id IS NULL").join(incoming.select("id").limit(1).select(F.lit(True).alias("any")), F.col("any"), "left_anti")
    return ingest.upsert(stored.filter("id IS NOT NULL").union(keyless), incoming, order="n", place="place").select("id", "v")


@register("diary_latest", "SELECT event_id, ts, event_type FROM events WHERE user_id = 7 ORDER BY ts DESC, event_id DESC LIMIT 10")
def diary_latest(spark, sf):
    return reader.latest(table(spark, sf, "events").filter("user_id = 7"), 10, "ts", "event_id").select("event_id", "ts", "event_type")


@register("file_context", f"WITH {CHUNKS} SELECT id, chunk_index, length(text) AS chars FROM chunks WHERE regexp_replace(source_file, '/src[0-9]+/', '/') = '/src/file_3.txt' ORDER BY chunk_index, id LIMIT 10000")
def file_context(spark, sf):
    merged = chunks(spark, sf).withColumn("source_file", F.regexp_replace("source_file", "/src[0-9]+/", "/"))
    return reader.file_context(merged, "/src/file_3.txt").select("id", "chunk_index", F.length("text").cast("long").alias("chars"))


@register("read_slice", f"WITH {CHUNKS}, l AS (SELECT id, unnest(string_split(text, chr(10))) AS text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS line FROM chunks WHERE wing = 'src2') SELECT id, line, text FROM l WHERE line BETWEEN 2 AND 5")
def read_slice(spark, sf):
    from tessellum.operators.reader import line_slice

    return line_slice(chunks(spark, sf).filter("wing = 'src2'"), 2, 5).select("id", F.col("line").cast("long").alias("line"), "text")


_SNIP = r"replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), chr(10), ' ')"


@register(
    "essential_story",
    f"WITH {CHUNKS}, t AS (SELECT * FROM chunks ORDER BY id LIMIT 15), e AS (SELECT room, row_number() OVER (PARTITION BY room ORDER BY id) AS k, '  - ' || CASE WHEN length({_SNIP}) > 200 THEN left({_SNIP}, 197) || '...' ELSE {_SNIP} END || '  (' || string_split(source_file, '/')[-1] || ')' AS line FROM t "
    "UNION ALL SELECT DISTINCT room, 0, chr(10) || '[' || room || ']' FROM t), s AS (SELECT *, sum(length(line)) OVER (ORDER BY room, k ROWS UNBOUNDED PRECEDING) AS total FROM e), p AS (SELECT *, bool_or(k > 0 AND total > 3200) OVER (ORDER BY room, k ROWS UNBOUNDED PRECEDING) AS past FROM s) "
    "SELECT '## L1 — ESSENTIAL STORY' || coalesce(chr(10) || string_agg(line, chr(10) ORDER BY room, k) FILTER (NOT past), '') || CASE WHEN bool_or(past) THEN chr(10) || '  ... (more in L3 search)' ELSE '' END AS story FROM p",
)
def essential_story(spark, sf):
    return layers.essential_story(chunks(spark, sf))


@register("recall_scope", f"WITH {CHUNKS} SELECT id, room, source_file, CASE WHEN length({_SNIP}) > 300 THEN left({_SNIP}, 297) || '...' ELSE {_SNIP} END AS snippet FROM chunks WHERE wing = 'src2' AND room = 'en' ORDER BY id LIMIT 10")
def recall_scope(spark, sf):
    return layers.recall(chunks(spark, sf), "src2", "en", 10)


@register("export_records", f"WITH {CHUNKS} SELECT id, wing, room, source_file, chunk_index FROM chunks WHERE wing = 'src5'")
def export_records(spark, sf):
    """What comes back of records that were written as JSON lines."""
    from tessellum.sources.jsonl import drawer_records, parse_drawers

    return parse_drawers(drawer_records(chunks(spark, sf).filter("wing = 'src5'"))).select("id", "wing", "room", "source_file", "chunk_index")


@register("token_overlap_f1", "WITH a AS (SELECT item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark WHERE item_id % 2 = 0), b AS (SELECT item_id - 1 AS item_id, unnest(string_split(lower(text), ' ')) AS w FROM benchmark WHERE item_id % 2 = 1), ca AS (SELECT item_id, w, count(*) AS n FROM a GROUP BY ALL), cb AS (SELECT item_id, w, count(*) AS n FROM b GROUP BY ALL), s AS (SELECT item_id, sum(least(ca.n, cb.n)) AS c FROM ca JOIN cb USING (item_id, w) GROUP BY 1), na AS (SELECT item_id, count(*) AS n FROM a GROUP BY 1), nb AS (SELECT item_id, count(*) AS n FROM b GROUP BY 1) SELECT item_id, round(coalesce(2.0 * c / (na.n + nb.n), 0.0), 6) AS f1 FROM na JOIN nb USING (item_id) LEFT JOIN s USING (item_id)")
def token_overlap_f1(spark, sf):
    from tessellum.operators.answers import token_f1

    b = table(spark, sf, "benchmark")
    left = b.filter("item_id % 2 = 0").select("item_id", F.col("text").alias("a"))
    right = b.filter("item_id % 2 = 1").select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("b"))
    return token_f1(left.join(right, "item_id"), "item_id", "a", "b").select("item_id", F.round("f1", 6).alias("f1"))


def _listed(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _coded(signals: dict[str, str], name: str) -> str:
    """The first three codes of words that a text holds, as they are declared."""
    values = ", ".join(f"({k}, '{w}', '{c}')" for k, (w, c) in enumerate(signals.items()))
    return f"{name} AS (SELECT id, string_agg(c, '+' ORDER BY k) AS codes FROM (SELECT id, c, min(k) AS k, row_number() OVER (PARTITION BY id ORDER BY min(k)) AS nth FROM t, (VALUES {values}) v(k, w, c) WHERE contains(lower(text), w) GROUP BY id, c) WHERE nth <= 3 GROUP BY id)"


_KEYS = " + ".join(f"CAST(contains(lower(s), '{w}') AS INT)" for w in summary.KEY_WORDS)


@register(
    "text_summary",
    "WITH t AS (SELECT conv_id || '/' || turn AS id, text FROM conversations), "
    r"w AS (SELECT id, regexp_replace(x, '[^a-zA-Z]', '', 'g') AS x, i FROM (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT id, list_filter(regexp_split_to_array(text, '\s+'), lambda y: y <> '') AS p FROM t)) WHERE i > 1), "
    f"n AS (SELECT id, string_agg(c, '+' ORDER BY i) AS names FROM (SELECT id, upper(left(x, 3)) AS c, min(i) AS i, row_number() OVER (PARTITION BY id ORDER BY min(i)) AS nth FROM w WHERE regexp_full_match(x, '[A-Z][a-z]+') AND lower(x) NOT IN ({_listed(summary.STOP)}) GROUP BY id, upper(left(x, 3))) WHERE nth <= 3 GROUP BY id), "
    "o AS (SELECT id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM (SELECT id, regexp_extract_all(text, '[a-zA-Z][a-zA-Z_-]{2,}') AS p FROM t)), "
    f"q AS (SELECT id, lower(x) AS x, sum(1 + 2 * CAST(regexp_matches(x, '^[A-Z]') AS INT) + 2 * CAST(regexp_matches(x, '[_-]|^.+[A-Z]') AS INT)) AS n, min(i) AS i FROM o WHERE lower(x) NOT IN ({_listed(summary.STOP)}) GROUP BY id, lower(x)), "
    "topics AS (SELECT id, string_agg(x, '_' ORDER BY n DESC, i) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, i) AS nth FROM q) WHERE nth <= 3 GROUP BY id), "
    r"z AS (SELECT id, regexp_replace(s, '^\s+|\s+$', '', 'g') AS s, i FROM (SELECT id, unnest(p) AS s, generate_subscripts(p, 1) AS i FROM (SELECT id, regexp_split_to_array(text, '[.!?\n]+') AS p FROM t))), "
    f"v AS (SELECT *, 2 * ({_KEYS}) + CAST(length(s) < 80 AS INT) + CAST(length(s) < 40 AS INT) - 2 * CAST(length(s) > 150 AS INT) AS v FROM z WHERE length(s) > 10), "
    "k AS (SELECT id, CASE WHEN length(s) > 55 THEN left(s, 52) || '...' ELSE s END AS s FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY v DESC, i) AS nth FROM v) WHERE nth = 1), "
    f"{_coded(summary.EMOTIONS, 'em')}, {_coded(summary.FLAGS, 'fl')} "
    "SELECT id, concat_ws('|', '0:' || coalesce(names, '???'), coalesce(topics, 'misc'), '\"' || k.s || '\"', em.codes, fl.codes) AS summary FROM t LEFT JOIN n USING (id) LEFT JOIN topics USING (id) LEFT JOIN k USING (id) LEFT JOIN em USING (id) LEFT JOIN fl USING (id)",
)
def text_summary(spark, sf):
    from tessellum.operators.summary import summarise

    return summarise(table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text"), "id")


@register("entity_classify")
def entity_classify(spark, sf):
    from tessellum.operators import entities

    turns = table(spark, sf, "conversations").select(F.concat_ws("/", "conv_id", "turn").alias("id"), "text")
    names = memories.name_candidates(turns, _STOP)
    return entities.top_per_type(entities.classify(names, entities.signs(turns, names, "id")))


_SAID = [("Alice", "Alice: hello\nAlice said yes. Hey Alice\nshe left", 3), ("Orchard", "We built Orchard and deployed Orchard. orchard.py\nthe Orchard pipeline", 3), ("Zeta", "Zeta zeta Zeta", 2)]


@register("entity_types", "SELECT name, n * (SELECT count(*) FROM part WHERE p_partkey % 3 = k) AS frequency, type, confidence FROM (VALUES (0, 'Alice', 3, 'person', 0.99), (1, 'Orchard', 3, 'project', 0.99), (2, 'Zeta', 2, 'uncertain', 0.4)) v(k, name, n, type, confidence)")
def entity_types(spark, sf):
    """Names whose signs are known, in texts that are told to parts in turn."""
    from tessellum.operators import entities

    text = F.element_at(F.array(*[F.lit(t) for _, t, _ in _SAID]), (F.col("p_partkey") % 3).cast("int") + 1)
    docs = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), text.alias("text"))
    names = memories.name_candidates(docs, [*_STOP, "we", "hey"])
    return entities.classify(names, entities.signs(docs, names, "id"))


@register("stale_sources", f"WITH {CHUNKS} SELECT DISTINCT source_file FROM chunks WHERE source_file NOT IN (SELECT source_file FROM chunks WHERE doc_id % 7 > 2)")
def stale_sources(spark, sf):
    c = chunks(spark, sf)
    return ingest.stale(c, c.filter("doc_id % 7 > 2"))


@register("resolve_source", f"WITH {CHUNKS}, f AS (SELECT DISTINCT source_file FROM chunks WHERE source_file LIKE '%/file_7.txt') SELECT source_file, CASE WHEN (SELECT count(*) FROM f) > 1 THEN 'ambiguous' ELSE 'suffix' END AS how FROM f")
def resolve_source(spark, sf):
    from tessellum.operators.reader import resolve_source as resolve

    return resolve(chunks(spark, sf), "file_7.txt")


# Distances in SQL count bytes, so letters of two are told as one of their own.
_ONE_BYTE = "translate({0}, 'äöüßéèêëàâçñíóúáôûùîïœæÿ', 'ABCDEFGHIJKLMNOPQRSTUVWX')"
_STAYS = "|".join(f"(?:{p})" for p in UNTOUCHED)


@register(
    "spelling_corrected",
    r"WITH dw AS (SELECT unnest(regexp_extract_all(text, '\p{L}+')) AS w FROM documents), dict AS (SELECT w, count(*) AS n, " + _ONE_BYTE.format("w") + r" AS x FROM dw WHERE regexp_full_match(w, '\p{Ll}{4,}') GROUP BY w HAVING count(*) >= 20), "
    r"tw AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(text, '\S+')), '[.,!?;:''" + r'"' + r")]*$', '') AS w FROM conversations), "
    r"aw AS (SELECT w, " + _ONE_BYTE.format("w") + f" AS x FROM tw WHERE length(w) >= 4 AND NOT regexp_matches(w, '{_STAYS}') AND NOT regexp_matches(w, '^\\p{{Lu}}') AND w NOT IN (SELECT w FROM dict)), "
    "near AS (SELECT a.w, arg_min(d.w, {'far': levenshtein(a.x, d.x), 'n': -d.n, 'w': d.w}) AS fix FROM aw a JOIN dict d ON length(d.x) BETWEEN length(a.x) - 1 AND length(a.x) + 1 AND levenshtein(a.x, d.x) <= 1 GROUP BY a.w), "
    "m AS (SELECT map(list(w), list(fix)) AS m FROM near) "
    r"SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '\s+|\S+'), lambda t: coalesce(m[regexp_replace(t, '[.,!?;:''" + r'"' + r")]*$', '')] || substr(t, length(regexp_replace(t, '[.,!?;:''" + r'"' + r")]*$', '')) + 1), t)), '') AS text FROM conversations, m",
)
def spelling_corrected(spark, sf):
    """Conversations, corrected by the words that the documents hold twenty times."""
    from tessellum.operators.spelling import correct

    words = F.filter(F.split("text", r"[^\p{L}]+"), lambda w: w.rlike(r"^\p{Ll}{4,}$"))
    dictionary = table(spark, sf, "documents").select(F.explode(words).alias("word")).groupBy("word").count().filter("count >= 20")
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text", F.concat_ws("/", "conv_id", "turn").alias("key"))
    return correct(turns, "key", dictionary).select("conv_id", "turn", "text")
