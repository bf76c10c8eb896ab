r"""DuckDB SQL for the registered queries, written independently of the Spark
plans: packing is a recursive walk, heading ancestry is a closed form."""

from __future__ import annotations

from stackleaf.catalog.fixtures import CAP, CONFIG, OTHER_CONFIG
from stackleaf.operators.prompts import ANSWER_FORM
from stackleaf.plans.settings import Settings

WS = "(' ' || chr(9) || chr(10) || chr(13))"


def _words(x: str) -> str:
    return rf"len(list_filter(string_split_regex({x}, '\s+'), lambda w: w <> ''))"


def _sentences(x: str) -> str:
    marked = rf"regexp_replace({x}, '([.!?])\s+', '\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({marked}, chr(1)), "
        f"lambda s: trim(s, {WS})), lambda s: s <> '')"
    )


def _parts(x: str, separator: str) -> str:
    return (
        f"list_filter(list_transform(string_split_regex({x}, '{separator}'), "
        f"lambda p: trim(p, {WS})), lambda p: p <> '')"
    )


# --- fixtures ------------------------------------------------------------------

FILES = """files AS (
  SELECT '/lake/' || source || '/Doc ' || doc_id || '-v1' ||
         CASE doc_id % 4 WHEN 0 THEN '.txt' WHEN 1 THEN '.md' WHEN 2 THEN '.PDF' ELSE '.docx' END AS path,
         text AS content, doc_id AS seq
  FROM documents)"""

SEGMENTS = rf"""seg AS MATERIALIZED (
  SELECT doc_id, unnest(range(len(l))) AS idx, unnest(l) AS text
  FROM (SELECT doc_id, {_parts('text', chr(92) + 'n+')} AS l FROM documents))"""


def _packed(items: str, group: str, run_para: str) -> str:
    """Greedy packing as a recursive walk. ``items``: (group, i, text, n, key,
    pages); ``run_para``: run of a unit that is no sentence."""
    return rf"""
unit0 AS (
  SELECT {group}, i, 0 AS j, 0 AS kind, text, n, key, pages FROM {items} WHERE n <= {CAP}
  UNION ALL
  SELECT {group}, i, unnest(range(len(l))), 1, unnest(l), NULL, key, pages
  FROM (SELECT {group}, i, key, pages, {_sentences('text')} AS l FROM {items} WHERE n > {CAP})),
unit AS MATERIALIZED (
  SELECT {group}, kind, key, pages, text, {_words('text')} AS n,
         CASE WHEN kind = 1 THEN i ELSE {run_para} END AS run,
         row_number() OVER (PARTITION BY {group} ORDER BY i, j) AS u
  FROM unit0),
walk AS (
  SELECT {group}, u, run, key, n AS total, 0 AS c FROM unit WHERE u = 1
  UNION ALL
  SELECT x.{group}, x.u, x.run, x.key,
         CASE WHEN x.run <> w.run OR x.key <> w.key OR w.total + x.n > {CAP} THEN x.n ELSE w.total + x.n END,
         w.c + CASE WHEN x.run <> w.run OR x.key <> w.key OR w.total + x.n > {CAP} THEN 1 ELSE 0 END
  FROM walk w JOIN unit x ON x.{group} = w.{group} AND x.u = w.u + 1),
packed0 AS (
  SELECT {group}, c AS chunk_index, any_value(kind) AS kind, any_value(unit.key) AS key,
         list(text ORDER BY u) AS texts,
         list_sort(list_distinct(flatten(list(pages)))) AS pages
  FROM walk JOIN unit USING ({group}, u) GROUP BY {group}, c),
packed AS MATERIALIZED (
  SELECT {group}, chunk_index, kind, key, pages,
         (count(*) OVER (PARTITION BY {group}))::INTEGER AS total_chunks,
         CASE WHEN kind = 1 THEN array_to_string(texts, ' ')
              ELSE array_to_string(texts, chr(10) || chr(10)) END AS text
  FROM packed0)"""


PACKED = (
    SEGMENTS
    + f""",
items AS (SELECT doc_id, idx AS i, text, {_words('text')} AS n, '' AS key, NULL::INT[] AS pages FROM seg),
"""
    + _packed("items", "doc_id", "-1")
)

OUTLINE = """base AS (
  SELECT s_suppkey * 3 AS pos, (s_suppkey // 100 + 1) || ' ' || s_name AS h FROM supplier WHERE s_suppkey % 100 = 0
  UNION ALL
  SELECT s_suppkey * 3 + 1, (s_suppkey // 100 + 1) || '.' || ((s_suppkey // 10) % 10 + 1) || ' ' || s_name
  FROM supplier WHERE s_suppkey % 10 = 0
  UNION ALL
  SELECT s_suppkey * 3 + 2,
         (s_suppkey // 100 + 1) || '.' || ((s_suppkey // 10) % 10 + 1) || '.' || (s_suppkey % 10 + 1) || ' ' || s_name
  FROM supplier),
outline AS MATERIALIZED (
  SELECT 'plain' AS doc, pos AS idx, h AS heading FROM base
  UNION ALL SELECT 'mixed', pos // 8 * 8 + (pos * 5) % 8, h FROM base
  UNION ALL SELECT 'front', pos,
    CASE WHEN pos % 7 = 3 THEN CASE WHEN pos % 2 = 0 THEN 'Preface' ELSE 'Contents' END ELSE h END FROM base
  UNION ALL SELECT 'gaps', pos, CASE WHEN pos % 5 = 4 THEN '' ELSE h END FROM base)"""


def _number(h: str) -> str:
    return rf"regexp_extract({h}, '^\s*(\d+(?:\.\d+)*)(?:\s|$)', 1)"


def _paths(rows: str) -> str:
    """``pth(doc, i, h, path, parent)`` for ``rows(doc, i, h)``, non-empty
    headings. The ancestor at a proper prefix p is there exactly if the last
    earlier heading that is not below p has the number p."""
    return f"""
hh AS MATERIALIZED (SELECT doc, i, h, {_number('h')} AS num FROM {rows}),
pre AS (
  SELECT doc, i, k, array_to_string(list_slice(parts, 1, k), '.') AS p
  FROM (SELECT doc, i, parts, unnest(range(1, len(parts))) AS k
        FROM (SELECT doc, i, string_split(num, '.') AS parts FROM hh WHERE num <> ''))),
anc AS (
  SELECT pre.doc, pre.i, pre.k, pre.p, arg_max(j.num, j.i) AS num, arg_max(j.h, j.i) AS h
  FROM pre JOIN hh j ON j.doc = pre.doc AND j.i < pre.i AND NOT starts_with(j.num, pre.p || '.')
  GROUP BY pre.doc, pre.i, pre.k, pre.p),
alist AS (SELECT doc, i, list(h ORDER BY k) AS up FROM anc WHERE num = p GROUP BY doc, i),
pth AS MATERIALIZED (
  SELECT hh.doc, hh.i, hh.h, array_to_string(list_append(coalesce(up, []), hh.h), ' => ') AS path,
         array_to_string(coalesce(up, []), ' => ') AS parent
  FROM hh LEFT JOIN alist USING (doc, i))"""


_TAGS = r"'(?s)<(h1|li|p)>(.*?)</(?:h1|li|p)>'"
BLOCKS = rf"""md AS (
  SELECT page_id, array_to_string(list_transform(pairs, lambda x, i:
      CASE WHEN x[1] = 'h1' THEN '# 1 ' || x[2]
           WHEN x[1] = 'li' THEN '- ' || x[2]
           WHEN (i - 1) % 3 = 0 THEN '## 1.' || (i - 1) || ' Part' || chr(10) || chr(10) || x[2]
           ELSE x[2] END), chr(10) || chr(10)) AS markdown
  FROM (SELECT page_id, list_zip(
          regexp_extract_all(html, {_TAGS}, 1),
          list_transform(regexp_extract_all(html, {_TAGS}, 2),
            lambda b: trim(regexp_replace(regexp_replace(b, '<[^>]+>', ' ', 'g'), '\s+', ' ', 'g')))) AS pairs
        FROM pages)),
apart AS (
  SELECT page_id,
    regexp_replace(regexp_replace(regexp_replace(markdown,
      '(?m)^(#{{1,6}}[ \t][^\n]*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'),
      '(?m)^([ \t]*(?:[-*+]|\d+[.)])[ \t][^\n]*)$', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g'),
      '(?m)((?:^\|[^\n]*\n?)+)', chr(10) || chr(10) || '\1' || chr(10) || chr(10), 'g') AS t
  FROM md),
blk0 AS (
  SELECT page_id, unnest(range(len(l))) AS idx, unnest(l) AS part
  FROM (SELECT page_id, {_parts('t', chr(92) + 'n' + chr(92) + 'n+')} AS l FROM apart)),
blk1 AS (
  SELECT page_id, idx, part, regexp_extract(part, '^(#{{1,6}})[ \t]', 1) AS hashes,
         regexp_extract(part, '^((?:[-*+]|\d+[.)])[ \t]+)', 1) AS marker
  FROM blk0),
blk AS MATERIALIZED (
  SELECT page_id, idx, idx // 10 + 1 AS page_no,
         CASE WHEN hashes <> '' THEN 'heading' WHEN marker <> '' THEN 'list'
              WHEN starts_with(part, '|') THEN 'table' ELSE 'paragraph' END AS kind,
         trim(substr(part, length(hashes) + length(marker) + 1), {WS}) AS text
  FROM blk1),
lead_ AS (SELECT *, lag(kind) OVER (PARTITION BY page_id ORDER BY idx) AS before FROM blk),
isl AS (
  SELECT *, sum(CASE WHEN kind = 'list' AND before = 'list' THEN 0 ELSE 1 END)
            OVER (PARTITION BY page_id ORDER BY idx) AS unit FROM lead_),
lists AS MATERIALIZED (
  SELECT page_id, unit, any_value(kind) AS kind, count(*) AS items,
         array_to_string(list(text ORDER BY idx), chr(10)) AS text,
         list(page_no ORDER BY idx) AS pages
  FROM isl GROUP BY page_id, unit)"""


def _structure(run_para: str) -> str:
    return (
        BLOCKS
        + ",\nhrows AS (SELECT page_id AS doc, unit AS i, text AS h FROM lists WHERE kind = 'heading' AND text <> ''),"
        + _paths("hrows")
        + f""",
placed AS (
  SELECT l.page_id, l.unit AS i, l.text, {_words('l.text')} AS n, coalesce(p.path, '') AS key, l.pages
  FROM lists l ASOF LEFT JOIN pth p ON p.doc = l.page_id AND p.i <= l.unit
  WHERE l.kind <> 'heading'),
"""
        + _packed("placed", "page_id", run_para)
        + """,
owner AS (SELECT DISTINCT doc AS page_id, path AS key, parent, h FROM pth),
structured AS (
  SELECT page_id, chunk_index, total_chunks, text, key AS headings, coalesce(parent, '') AS parent_headings,
         pages, concat_ws(chr(10), nullif(parent, ''), nullif(h, ''), text) AS enriched_text
  FROM packed LEFT JOIN owner USING (page_id, key))"""
    )


ARRIVALS = f"""half AS (SELECT (max(doc_id) + 1) // 2 AS half FROM documents),
arr AS MATERIALIZED (
  SELECT 'current' AS side, doc_id AS seq, 'f' || doc_id || '.txt' AS filename, text, sha256(text) AS content_hash
  FROM documents, half WHERE doc_id < half
  UNION ALL
  SELECT 'incoming', b.doc_id,
         CASE WHEN b.doc_id % 3 = 1 THEN 'g' || b.doc_id ELSE 'f' || a.doc_id END || '.txt',
         CASE WHEN b.doc_id % 3 = 2 THEN a.text ELSE b.text END,
         sha256(CASE WHEN b.doc_id % 3 = 2 THEN a.text ELSE b.text END)
  FROM documents b, half, documents a WHERE b.doc_id >= half AND a.doc_id = b.doc_id - half),
live0 AS (SELECT content_hash, min(filename) AS filename FROM arr WHERE side = 'current' GROUP BY content_hash),
inc AS (SELECT filename, content_hash FROM arr WHERE side = 'incoming'),
evicted AS (
  SELECT l.filename, l.content_hash FROM live0 l JOIN inc i ON i.filename = l.filename AND i.content_hash <> l.content_hash),
staying AS (SELECT * FROM live0 WHERE content_hash NOT IN (SELECT content_hash FROM evicted)),
registered AS (
  SELECT content_hash, min(filename) AS filename FROM inc
  WHERE content_hash NOT IN (SELECT content_hash FROM staying) GROUP BY content_hash),
live AS MATERIALIZED (
  SELECT filename, content_hash FROM staying UNION ALL SELECT filename, content_hash FROM registered)"""

CHUNKS = f"""chunks AS MATERIALIZED (
  SELECT 'c' || vec_id AS chunk_id, sha256(coalesce(text, '')) AS content_hash, 'f' || vec_id || '.txt' AS filename,
         CASE WHEN label = 0 THEN 'Contents' ELSE (label + 1) || ' S => ' || (label + 1) || '.1 T' END AS headings,
         CASE WHEN label = 0 THEN '' ELSE (label + 1) || ' S' END AS parent_headings,
         concat_ws(' ', lang, source) AS summary,
         CASE WHEN label = 3 THEN '' ELSE coalesce(text, '') END AS raw_text,
         CASE WHEN label = 0 THEN 'Contents' ELSE (label + 1) || ' S => ' || (label + 1) || '.1 T' END
           || chr(10) || coalesce(text, '') AS page_content,
         label AS chunk_index, label || ',' || (label + 1) AS page_numbers,
         CASE WHEN label % 2 = 0 THEN '{CONFIG}' ELSE '{OTHER_CONFIG}' END AS config,
         embedding::DOUBLE[] AS e
  FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
questions AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings)"""


def _ranked(score: str, direction: str, k: int, where: str = "true") -> str:
    return f"""scored AS (
  SELECT query_id, chunk_id, round({score}, 6) + 0.0 AS score FROM questions, chunks WHERE {where}),
hits AS MATERIALIZED (
  SELECT query_id, chunk_id, score,
         (row_number() OVER (PARTITION BY query_id ORDER BY score {direction}, chunk_id))::INTEGER AS rank
  FROM scored QUALIFY rank <= {k})"""


_COSINE = "list_cosine_similarity(e, q)"
PREFILTERED = f"WITH {CHUNKS}, {_ranked(_COSINE, 'DESC', 10, chr(39).join(['headings <> ', 'Contents', '']))}"
_SHOWN = f"""{PREFILTERED},
shown AS (
  SELECT query_id, rank, headings, parent_headings, summary,
         coalesce(nullif(raw_text, ''), page_content) AS page_content
  FROM hits JOIN chunks USING (chunk_id)),
results AS (
  SELECT query_id, array_to_string(list('--- Passage ' || rank || ' ---' || chr(10) || 'Section: ' || parent_headings
         || chr(10) || 'Summary: ' || summary || chr(10) || page_content || chr(10) ORDER BY rank), chr(10)) AS results
  FROM shown GROUP BY query_id)"""
_ASKED = f"""{_SHOWN},
asked AS (
  SELECT query_id, 'Question:' || chr(10) || 'What is near ' || query_id || '?' || chr(10) || chr(10)
         || '{ANSWER_FORM.strip()}' || chr(10) || chr(10) || 'Passages:' || chr(10) || coalesce(results, '') AS prompt
  FROM questions LEFT JOIN results USING (query_id))"""

_NAMED = CHUNKS.replace("chunks AS", "plain AS", 1)


def _every_twentieth(named: bool) -> str:
    """The exact search for vectors whose id is divisible by 20; a chunk of a stored
    index is named with its document."""
    chunks = f"{_NAMED}, chunks AS (SELECT * REPLACE (content_hash || '_' || chunk_id AS chunk_id) FROM plain)" if named else CHUNKS
    return f"WITH {chunks}, {_ranked(_COSINE, 'DESC', 10, 'query_id % 20 = 0')} SELECT query_id, rank, chunk_id, score FROM hits"


_RECALLED = "SELECT count(*) FILTER (vec_id % 20 = 0) * least(10, count(*)) AS wanted, true AS recall_reached FROM embeddings"
_LETTERS = "list_transform(string_split('abcdefghijklmnopqrstuvwxyz', ''), lambda c: (len(lower({0})) - len(replace(lower({0}), c, '')))::DOUBLE)"
_TEXTS = f"""distinct_texts AS MATERIALIZED (
  SELECT sha256(text) AS content_hash, 'f' || min(doc_id) AS filename, any_value(text) AS text
  FROM documents WHERE text IS NOT NULL GROUP BY sha256(text))"""
_TEXT_HITS = f"""{_TEXTS},
coded AS MATERIALIZED (SELECT *, {_LETTERS.format('text')} AS e FROM distinct_texts),
asked AS MATERIALIZED (SELECT doc_id AS query_id, left(text, 200) AS question, {_LETTERS.format('left(text, 200)')} AS q
  FROM documents WHERE doc_id % 20 = 0 AND text IS NOT NULL),
scored AS (SELECT query_id, question, filename, content_hash, text,
    round(coalesce(list_cosine_similarity(e, q), 0.0), 6) + 0.0 AS score FROM asked, coded),
hits AS MATERIALIZED (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, content_hash))::INTEGER AS rank
  FROM scored QUALIFY rank <= 10)"""

_STEM = (
    r"lower(replace(replace(regexp_replace(filename, '(.)\.[^.]+$', '\1'), ' ', '_'), '-', '_'))"
)
_REPLIES = """replies AS (
  SELECT doc_id, text, CASE doc_id % 5 WHEN 0 THEN text WHEN 1 THEN '# Summary' || chr(10) || chr(10) || text
         WHEN 2 THEN '**Summary:** ' || text WHEN 3 THEN 'Summary: ' || text ELSE NULL END AS reply
  FROM documents)"""


def _cleaned(x: str) -> str:
    first = rf"regexp_replace({x}, '(?i)^\s*#{{1,6}}\s*summary\s*\n+', '')"
    second = rf"regexp_replace({first}, '(?i)^\s*\**\s*summary\s*\**\s*:\s*\**\s*', '')"
    return f"trim({second}, {WS})"


def _config_json(**over: str) -> str:
    """The canonical settings text as an SQL expression."""
    from dataclasses import asdict

    out = []
    for name, value in sorted(asdict(Settings()).items()):
        text = over.get(name, "'" + (str(value).lower() if isinstance(value, bool) else str(value)) + "'")
        quote = '"' if isinstance(value, str) else ""
        out.append(f"'\"{name}\": {quote}' || {text} || '{quote}'")
    return "'{' || " + " || ', ' || ".join(out) + " || '}'"


_ROUTE = """CASE WHEN path LIKE '%.PDF' THEN 'custom' WHEN path LIKE '%.docx' THEN NULL ELSE 'plaintext' END"""
_PARSED = rf"""WITH {FILES},
p0 AS (
  SELECT path AS source_path, string_split(path, '/')[-1] AS filename, sha256(content) AS content_hash,
         {_ROUTE} AS parser, path,
         CASE WHEN path LIKE '%.PDF' THEN trim(regexp_replace(content, '\n{{3,}}', chr(10) || chr(10), 'g'), {WS})
              ELSE content END AS markdown
  FROM files),
parsed AS (
  SELECT *, CASE WHEN parser IS NULL THEN 'no parser for unknown'
                 WHEN parser = 'custom' AND length(markdown) < 500 THEN 'too short' END AS reason
  FROM p0)"""

_CHUNK12 = "left(sha256(text), 12)"

_INGESTED = f"""WITH RECURSIVE {ARRIVALS}, {PACKED},
      one AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
      SELECT filename, content_hash, {_CHUNK12} AS chunk_id, max(chunk_index) AS chunk_index, max(total_chunks) AS total_chunks
      FROM live JOIN one USING (content_hash) JOIN packed USING (doc_id) GROUP BY filename, content_hash, chunk_id"""
_LIVE_COUNTS = f"""WITH RECURSIVE {ARRIVALS}, {PACKED},
      one AS (SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1)
      SELECT filename, content_hash, coalesce(max(total_chunks), 0)::INTEGER AS chunk_count
      FROM live JOIN one USING (content_hash) LEFT JOIN packed USING (doc_id) GROUP BY filename, content_hash"""

ORACLE: dict[str, str] = {
    "scan_supported": rf"WITH {FILES} SELECT path, lower(regexp_extract(path, '(\.[^./]+)$', 1)) AS suffix FROM files "
    "WHERE suffix IN ('.pdf', '.md', '.txt')",
    "content_type": f"""WITH {FILES}, s AS (
        SELECT path FROM files UNION ALL SELECT url FROM pages UNION ALL SELECT 'https://youtu.be/' || page_id FROM pages)
      SELECT path, CASE WHEN regexp_matches(path, '^https?://') THEN
          CASE WHEN contains(path, 'youtube.com') OR contains(path, 'youtu.be') THEN 'youtube' ELSE 'web' END
        WHEN lower(path) LIKE '%.pdf' THEN 'pdf' WHEN lower(path) LIKE '%.ipynb' THEN 'notebook'
        WHEN lower(path) LIKE '%.md' THEN 'markdown' WHEN lower(path) LIKE '%.txt' THEN 'text'
        ELSE 'unknown' END AS content_type FROM s""",
    "route_rejects": f"{_PARSED} SELECT source_path, content_hash, reason FROM parsed WHERE reason IS NOT NULL",
    "parse_custom": rf"""{_PARSED} SELECT source_path, filename, ltrim(lower(regexp_extract(path, '(\.[^./]+)$', 1)), '.') AS content_type,
      parser, content_hash, {_STEM} || '_' || left(content_hash, 12) || '_' || parser AS doc_key, length(markdown) AS chars
      FROM parsed WHERE reason IS NULL""",
    "decode_text": f"WITH {FILES} SELECT path, content AS markdown FROM files",
    "short_rejects": rf"""SELECT doc_id, length(t) AS chars FROM (
      SELECT doc_id, trim(regexp_replace(text, '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS t FROM documents)
      WHERE length(t) < 500""",
    "content_hash": f"WITH {FILES} SELECT path, sha256(content) AS content_hash FROM files",
    "config_fingerprint": f"""SELECT doc_id,
      left(sha256({_config_json(chunk_max_tokens='n_chars', parser='source')}), 12) AS config,
      left(sha256({_config_json()}), 12) AS default_config FROM documents""",
    "doc_key": f"""WITH {FILES}, n AS (SELECT path, content, string_split(path, '/')[-1] AS filename FROM files)
      SELECT path, filename, {_STEM} AS stem,
             {_STEM} || '_' || left(sha256(content), 12) || '_plaintext' AS doc_key FROM n""",
    "chunk_ids": f"""WITH RECURSIVE {PACKED}
      SELECT doc_id, chunk_index, h || '_{CONFIG}' AS registry_key, {_CHUNK12} AS chunk_id,
             'chunks/{CONFIG}/' || h || '_' || {_CHUNK12} || '.txt' AS object_key
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id)""",
    "binary_hash": """SELECT doc_id,
      (('0x' || right(sha256(text), 16))::UBIGINT % 9223372036854775808)::BIGINT AS binary_hash FROM documents""",
    "page_codec": """WITH p AS (SELECT doc_id, CASE WHEN n_chars < 500 THEN []::BIGINT[]
        ELSE range(1, n_chars // 1800 + 2) END AS l FROM documents)
      SELECT doc_id, array_to_string(l, ',') AS page_numbers, len(l) AS pages,
             coalesce(list_sum(l), 0)::BIGINT AS page_sum FROM p""",
    "clean_text": rf"""SELECT doc_id, trim(regexp_replace(' ' || chr(10) || chr(10) ||
        replace(text, chr(10), chr(10) || chr(10) || chr(10) || chr(10)) || chr(10) || ' ',
        '\n{{3,}}', chr(10) || chr(10), 'g'), {WS}) AS cleaned FROM documents""",
    "paragraphs": f"WITH {SEGMENTS} SELECT doc_id, idx, text FROM seg",
    "token_counts": f"WITH {SEGMENTS} SELECT doc_id, idx, {_words('text')} AS tokens FROM seg",
    "pack_paragraphs": f"WITH RECURSIVE {PACKED} SELECT doc_id, chunk_index, total_chunks, text FROM packed WHERE kind = 0",
    "pack_sentences": f"WITH RECURSIVE {PACKED} SELECT doc_id, chunk_index, total_chunks, text FROM packed WHERE kind = 1",
    "chunk_index": f"""WITH {SEGMENTS} SELECT doc_id, idx::INTEGER AS line,
      (row_number() OVER (PARTITION BY doc_id ORDER BY idx) - 1)::INTEGER AS chunk_index,
      count(*) OVER (PARTITION BY doc_id) AS total_chunks FROM seg""",
    "dedup_chunks": f"""WITH RECURSIVE {PACKED} SELECT doc_id, {_CHUNK12} AS chunk_id, max(chunk_index) AS chunk_index
      FROM packed GROUP BY 1, 2""",
    "heading_numbers": f"""WITH {OUTLINE}, {SEGMENTS},
      r AS (SELECT doc, idx, heading FROM outline UNION ALL SELECT doc_id::VARCHAR, idx, text FROM seg),
      n AS (SELECT doc, idx, {_number('heading')} AS number, string_split(number, '.') AS parts FROM r)
      SELECT doc, idx, number, CASE WHEN number = '' THEN 1 ELSE len(parts) END AS level,
        array_to_string(list_transform(range(1, len(parts)), lambda k: array_to_string(list_slice(parts, 1, k), '.')), ',') AS ancestors
      FROM n""",
    "heading_paths": f"""WITH {OUTLINE}, o AS (SELECT doc, idx AS i, heading AS h FROM outline WHERE heading <> ''),
      {_paths('o')} SELECT doc, i AS idx, path, parent AS parent_path FROM pth""",
    "heading_carry": f"""WITH {OUTLINE}, o AS (SELECT doc, idx AS i, heading AS h FROM outline WHERE heading <> ''),
      {_paths('o')} SELECT r.doc, r.idx, coalesce(p.path, '') AS path
      FROM outline r ASOF LEFT JOIN pth p ON p.doc = r.doc AND p.i <= r.idx""",
    "structure_chunks": f"""WITH RECURSIVE {_structure('-1')}
      SELECT page_id, chunk_index, total_chunks, text, headings, parent_headings FROM structured""",
    "merge_peers": f"""WITH RECURSIVE {_structure('i')}
      SELECT page_id, chunk_index, total_chunks, text, headings, parent_headings FROM structured""",
    "rechunk_from_parsed": f"""WITH RECURSIVE {_structure('-1')}
      SELECT page_id, chunk_index, total_chunks, text, headings, parent_headings FROM structured""",
    "contextualize": f"""WITH RECURSIVE {_structure('-1')} SELECT page_id, chunk_index, enriched_text FROM structured""",
    "page_span": f"""WITH RECURSIVE {_structure('-1')}
      SELECT page_id, chunk_index, array_to_string(pages, ',') AS page_numbers FROM structured""",
    "merge_list_items": f"WITH {BLOCKS} SELECT page_id, unit::BIGINT AS unit, kind, items, text FROM lists",
    "chunks_json_roundtrip": f"""WITH RECURSIVE {PACKED}
      SELECT 'f' || doc_id || '.txt' AS filename, h AS content_hash, {_CHUNK12} AS chunk_id, chunk_index, total_chunks, text
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id)""",
    "chunk_store_roundtrip": f"""WITH RECURSIVE {PACKED}
      SELECT 'chunks/{CONFIG}/' || h || '_' || {_CHUNK12} || '.txt' AS object_key, text AS raw_text,
             'f' || doc_id || '.txt' AS filename, h AS content_hash, {_CHUNK12} AS chunk_id,
             chunk_index, total_chunks, '' AS page_numbers
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id)""",
    "config_scope": f"""WITH RECURSIVE {PACKED}
      SELECT 'f' || doc_id || '.txt' AS filename, '{OTHER_CONFIG}' AS pipeline_config_hash, {_CHUNK12} AS chunk_id, chunk_index,
             (('0x' || right(h, 16))::UBIGINT % 9223372036854775808)::BIGINT AS binary_hash
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id)""",
    "prune_configs": f"""WITH RECURSIVE {PACKED}
      SELECT '{CONFIG}' AS pipeline_config_hash, count(*) AS chunks, count(DISTINCT h) AS documents
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id)""",
    "ingest_report": f"""WITH RECURSIVE {PACKED}
      SELECT h AS content_hash, 'f' || doc_id || '.txt' AS filename, count(*) AS chunk_count
      FROM packed JOIN (SELECT doc_id, sha256(text) AS h FROM documents) USING (doc_id) GROUP BY ALL""",
    "ledger_current": f"""WITH e AS (
        SELECT doc_id * 2 AS seq, 'register' AS op, doc_id FROM documents
        UNION ALL SELECT doc_id * 2 + 1, 'delete', doc_id FROM documents JOIN labels USING (doc_id) WHERE toxic = 1),
      f AS (SELECT e.*, sha256(text) AS content_hash,
              CASE WHEN doc_id % 2 = 0 THEN '{CONFIG}' ELSE '{OTHER_CONFIG}' END AS pipeline_config_hash
            FROM e JOIN documents USING (doc_id)),
      l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY content_hash, pipeline_config_hash ORDER BY seq DESC) = 1)
      SELECT 'f' || doc_id || '.txt' AS filename, '/lake/f' || doc_id || '.txt' AS source_path, content_hash,
             'plaintext' AS parser, pipeline_config_hash, 1 AS chunk_count FROM l WHERE op = 'register'""",
    "skip_ingested": f"""WITH {ARRIVALS} SELECT filename, content_hash FROM inc
      WHERE content_hash NOT IN (SELECT content_hash FROM live0)""",
    "ledger_lookup": f"""WITH {ARRIVALS} SELECT inc.content_hash, live0.filename
      FROM inc LEFT JOIN live0 USING (content_hash)""",
    "ledger_insert_new": f"""WITH {ARRIVALS} SELECT filename, content_hash,
      CASE WHEN content_hash IN (SELECT content_hash FROM live0)
        OR row_number() OVER (PARTITION BY content_hash ORDER BY filename) > 1 THEN 'conflict' ELSE 'insert' END AS outcome FROM inc""",
    "find_superseded": f"WITH {ARRIVALS} SELECT filename, content_hash FROM evicted",
    "supersede_snapshot": f"WITH {ARRIVALS} SELECT filename, content_hash FROM live",
    "supersede_events": f"""WITH {ARRIVALS} SELECT 'delete' AS op, filename, content_hash FROM evicted
      UNION ALL SELECT 'register', filename, content_hash FROM registered""",
    "compact_chunks": f"""WITH RECURSIVE {ARRIVALS}, {PACKED}
      SELECT doc_id, chunk_index, {_CHUNK12} AS chunk_id FROM packed
      WHERE doc_id IN (SELECT doc_id FROM documents WHERE sha256(text) IN (SELECT content_hash FROM live))""",
    "ingest_batch": _INGESTED,
    "stream_ingest": _LIVE_COUNTS,
    "summarize_default": f"""WITH RECURSIVE {PACKED}
      SELECT doc_id, chunk_index, array_to_string(list_slice({_sentences('text')}, 1, 2), ' ') AS summary FROM packed""",
    "summarize_client": f"""WITH RECURSIVE {PACKED}
      SELECT doc_id, chunk_index, NOT contains(text, '.') AS failed,
        CASE WHEN contains(text, '.') THEN {_words('text')} || ' words' ELSE left(text, 300) END AS summary FROM packed""",
    "clean_summary": f"WITH {_REPLIES} SELECT doc_id, {_cleaned('reply')} AS summary FROM replies WHERE reply IS NOT NULL",
    "summary_fallback": f"WITH {_REPLIES} SELECT doc_id, coalesce({_cleaned('reply')}, left(text, 300)) AS summary FROM replies",
    "structured_reply": "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text ELSE '' END AS summary FROM documents",
    "embed_hashing": f"""SELECT doc_id, 64::BIGINT AS dims, CASE WHEN {_words('text')} > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS norm
      FROM documents""",
    "topk_cosine": f"WITH {CHUNKS}, {_ranked(_COSINE, 'DESC', 10)} SELECT query_id, rank, chunk_id, score FROM hits",
    "topk_l2": f"WITH {CHUNKS}, {_ranked('list_distance(e, q)', 'ASC', 10)} SELECT query_id, rank, chunk_id, score FROM hits",
    "topk_ip": f"WITH {CHUNKS}, {_ranked('list_inner_product(e, q)', 'DESC', 10)} SELECT query_id, rank, chunk_id, score FROM hits",
    "topk_prefilter": f"{PREFILTERED} SELECT query_id, rank, chunk_id, score FROM hits",
    "topk_postfilter": f"""WITH {CHUNKS}, {_ranked(_COSINE, 'DESC', 20)},
      kept AS (SELECT query_id, chunk_id, score FROM hits JOIN chunks USING (chunk_id)
               WHERE headings <> 'Contents' AND config = '{CONFIG}')
      SELECT query_id, chunk_id, score, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank
      FROM kept QUALIFY rank <= 10""",
    "hit_projection": f"{_SHOWN} SELECT * FROM shown",
    "hit_citations": f"""{PREFILTERED} SELECT query_id, rank, chunk_id, filename, content_hash, chunk_index,
      10 AS total_chunks, page_numbers FROM hits JOIN chunks USING (chunk_id)""",
    "format_hits": f"{_SHOWN} SELECT query_id, results FROM results",
    "prompt_build": f"{_ASKED} SELECT query_id, prompt FROM asked",
    "answer_batch": f"{_ASKED} SELECT query_id, sha256(prompt) AS answer FROM asked",
    "ivf_flat": f"WITH {CHUNKS}, {_ranked(_COSINE, 'DESC', 10)} SELECT query_id, rank, chunk_id, score FROM hits",
    "ivf_sq8": f"""WITH {CHUNKS.replace('chunks AS', 'base AS', 1)},
      rng AS (SELECT d, min(x) AS lo, max(x) AS hi
              FROM (SELECT unnest(e) AS x, unnest(range(1, len(e) + 1)) AS d FROM base) GROUP BY d),
      lims AS (SELECT list(lo ORDER BY d) AS lo, list(hi ORDER BY d) AS hi FROM rng),
      coded AS MATERIALIZED (SELECT chunk_id, e AS exact, lo, hi, list_transform(e, lambda x, i: CASE WHEN hi[i] = lo[i] THEN -128
                ELSE floor((x - lo[i]) / (hi[i] - lo[i]) * 255.0::DOUBLE + 0.5::DOUBLE) - 128 END) AS code FROM base, lims),
      chunks AS MATERIALIZED (SELECT chunk_id, exact, list_transform(code, lambda c, i:
                lo[i] + (c + 128.0::DOUBLE) / 255.0::DOUBLE * (hi[i] - lo[i])) AS e FROM coded),
      {_ranked(_COSINE, 'DESC', 40)}
      SELECT query_id, chunk_id, round(list_cosine_similarity(exact, q), 6) + 0.0 AS score,
             (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id))::INTEGER AS rank
      FROM (SELECT query_id, chunk_id FROM hits) JOIN chunks USING (chunk_id) JOIN questions USING (query_id)
      QUALIFY rank <= 10""",
    "topk_blocked": _every_twentieth(False),
    "topk_postfill": f"WITH {CHUNKS}, {_ranked(_COSINE, 'DESC', 10, f"headings <> 'Contents' AND config = '{CONFIG}'")} "
    "SELECT query_id, rank, chunk_id, score FROM hits",
    "index_search": _every_twentieth(True),
    "index_search_sq8": _RECALLED,
    "index_recall": _RECALLED,
    "ask_citations": f"WITH {_TEXT_HITS} SELECT query_id, rank, filename, content_hash, 0::BIGINT AS pages FROM hits",
    "ask_text": f"""WITH {_TEXT_HITS},
      results AS (SELECT query_id, array_to_string(list('--- Passage ' || rank || ' ---' || chr(10) || 'Section: ' || chr(10)
          || 'Summary: ' || chr(10) || text || chr(10) ORDER BY rank), chr(10)) AS results FROM hits GROUP BY query_id)
      SELECT query_id, sha256('Question:' || chr(10) || question || chr(10) || chr(10) || '{ANSWER_FORM.strip()}' || chr(10) || chr(10)
        || 'Passages:' || chr(10) || coalesce(results, '')) AS answer FROM asked LEFT JOIN results USING (query_id)""",
    "delete_document": f"""WITH {_TEXTS} SELECT filename, content_hash,
      CASE WHEN substr(filename, 2)::BIGINT % 7 = 0 THEN 'deleted' ELSE 'live' END AS state FROM distinct_texts""",
    "compact_in_place": f"""WITH {_TEXTS}, left_ AS (SELECT * FROM distinct_texts WHERE substr(filename, 2)::BIGINT % 7 <> 0)
      SELECT reader, filename, content_hash FROM left_, (VALUES ('opened'), ('after'), ('stored')) r(reader)
      UNION ALL SELECT 'before', filename, content_hash FROM distinct_texts""",
    "ledger_two_writers": f"""WITH {ARRIVALS}, told AS (SELECT filename, content_hash,
      CASE WHEN content_hash IN (SELECT content_hash FROM live0)
        OR row_number() OVER (PARTITION BY content_hash ORDER BY filename) > 1 THEN 'conflict' ELSE 'insert' END AS outcome FROM inc)
      SELECT * FROM told UNION ALL SELECT filename, content_hash, 'entry' FROM told WHERE outcome = 'insert'
      UNION ALL SELECT filename, content_hash, 'entry' FROM live0""",
    "rechunk_generation": _INGESTED,
    "follow_folder": _LIVE_COUNTS,
}
