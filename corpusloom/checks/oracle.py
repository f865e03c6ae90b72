"""SQL for DuckDB that states each registered query on its own terms.

Common steps are named fragments; a query lists what it stands on and the
fragments are put in front of it as common table expressions.
"""

from __future__ import annotations

from corpusloom.checks import inputs, queries
from corpusloom.functions import text as tx
from corpusloom.functions import urls
from corpusloom.operators import embedding as emb
from corpusloom.operators import extraction
from corpusloom.operators import similarity as sim
from corpusloom.sources import files

WS = tx.WHITESPACE
SIZE, OVERLAP, BLOCK = tx.CHUNK_SIZE, tx.CHUNK_OVERLAP, tx.BLOCK_SIZE
DIM = inputs.DIM
SITE = inputs.SITE_PAGES
BANDS = queries.BANDS
(P1, P2, P3), PM = sim.PLANE_STEPS, sim.PLANE_MODULUS


def strip(c: str) -> str:
    return f"regexp_replace({c}, '^{WS}+|{WS}+$', '', 'g')"


def sentence_list(c: str) -> str:
    marked = f"regexp_replace({strip(c)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return f"list_filter(string_split({marked}, chr(1)), lambda x: x <> '')"


def content_id(c: str) -> str:
    h = f"sha1(unhex('{tx.DNS_NAMESPACE}') || encode({c}))"
    return (
        f"(substr({h},1,8) || '-' || substr({h},9,4) || '-5' || substr({h},14,3) || '-' || "
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab') || substr({h},18,3) || '-' || "
        f"substr({h},21,12))"
    )


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def unescape(c: str) -> str:
    out = c
    for name, char in tx.NAMED_REFERENCES.items():
        out = f"replace({out}, '&{name};', {quoted(char)})"
    return out


def main_text(c: str) -> str:
    out = f"regexp_replace({c}, {quoted(tx.hidden_pattern(tx.DROPPED_ELEMENTS))}, '', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:td|th)(?:\s[^>]*)?>', ' ', 'g')"
    out = rf"regexp_replace({out}, '(?i)</?(?:{'|'.join(tx.BLOCK_ELEMENTS)})(?:\s[^>]*)?/?>', chr(10), 'g')"
    out = rf"regexp_replace({out}, '<[A-Za-z/!][^>]*>', '', 'g')"
    out = unescape(out)
    out = rf"regexp_replace({out}, '[\t\x{{a0}} ]+', ' ', 'g')"
    out = rf"regexp_replace({out}, ' ?[\r\n][ \r\n]*', chr(10), 'g')"
    return strip(out)


def part(url: str, i: int) -> str:
    return f"regexp_extract({url}, {quoted(urls.PARTS)}, {i})"


def internal(url: str, domain: str) -> str:
    ends = " AND ".join(f"NOT lower({part(url, 3)}) LIKE '%{e}'" for e in urls.SKIPPED_ENDINGS)
    return f"({part(url, 2)} = {domain} AND lower({part(url, 1)}) IN ('http', 'https') AND {ends})"


def vectors(name: str, source: str, key: str, text: str, dim: int) -> dict[str, tuple[list[str], str]]:
    """Fragments that embed ``source.text`` as ``name(key, v)``.

    Grams of three characters of the padded text, summed by sign per bucket.
    """
    r, m = emb.GRAM_RADIX, emb.GRAM_MODULUS
    return {
        f"{name}_g": (
            [source],
            f"SELECT {key}, list_transform(c, lambda x: unicode(x)::BIGINT) AS u FROM "
            f"(SELECT {key}, string_split(' ' || {text} || ' ', '') AS c FROM {source})",
        ),
        f"{name}_h": (
            [f"{name}_g"],
            f"SELECT {key}, unnest(list_transform(range(1, len(u) - 1), "
            f"lambda i: ((u[i] * {r} + u[i+1]) * {r} + u[i+2]) % {m})) AS h FROM {name}_g",
        ),
        f"{name}_b": (
            [f"{name}_h"],
            f"SELECT {key}, h % {dim} AS b, sum((h // {dim}) % 2 * 2 - 1)::DOUBLE AS w FROM {name}_h GROUP BY ALL",
        ),
        name: (
            [f"{name}_b", f"{name}_g"],
            f"SELECT k.{key}, list((coalesce(w, 0) / greatest(n, 1e-300))::FLOAT ORDER BY d.b) AS v FROM {name}_g k "
            f"CROSS JOIN range({dim}) d(b) LEFT JOIN {name}_b x ON x.{key} = k.{key} AND x.b = d.b "
            f"LEFT JOIN (SELECT {key}, sqrt(sum(w * w)) AS n FROM {name}_b GROUP BY {key}) z ON z.{key} = k.{key} "
            f"GROUP BY k.{key}",
        ),
    }


def cosine(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}::DOUBLE[], {b}::DOUBLE[]), 9)"


def leader_fragments(name: str, source: str, key: str, threshold: float) -> dict[str, tuple[list[str], str]]:
    """Sequential leader choice over ``source(key, o, v)`` in order ``o`` = 1..n."""
    return {
        f"{name}_sim": (
            [source],
            f"SELECT a.o AS i, b.o AS j, {cosine('a.v', 'b.v')} AS s FROM {source} a JOIN {source} b ON a.o < b.o "
            f"WHERE {cosine('a.v', 'b.v')} >= {threshold}",
        ),
        f"{name}_nb": ([f"{name}_sim"], f"SELECT j, list(i) AS before FROM {name}_sim GROUP BY j"),
        f"{name}_run": (
            [f"{name}_nb", source],
            f"SELECT 0::BIGINT AS o, []::BIGINT[] AS led UNION ALL "
            f"SELECT r.o + 1, CASE WHEN list_has_any(r.led, coalesce(nb.before, []::BIGINT[])) THEN r.led "
            f"ELSE list_append(r.led, r.o + 1) END FROM {name}_run r LEFT JOIN {name}_nb nb ON nb.j = r.o + 1 "
            f"WHERE r.o < (SELECT count(*) FROM {source})",
        ),
        f"{name}_led": ([f"{name}_run"], f"SELECT unnest(led) AS o FROM (SELECT led FROM {name}_run ORDER BY o DESC LIMIT 1)"),
    }


FRAGMENTS: dict[str, tuple[list[str], str]] = {
    # sentences and chunks
    "sent": ([], f"SELECT doc_id, {sentence_list('text')} AS s FROM documents"),
    "sent_rows": (["sent"], "SELECT doc_id, unnest(range(len(s))) AS pos, unnest(s) AS sentence FROM sent"),
    "sums": (
        ["sent_rows"],
        "SELECT doc_id, list(c ORDER BY pos) AS cum FROM (SELECT doc_id, pos, "
        "sum(length(sentence)) OVER (PARTITION BY doc_id ORDER BY pos)::BIGINT AS c FROM sent_rows) GROUP BY doc_id",
    ),
    # cz[i + 1] is the length of the first i sentences
    "packed": (["sums", "sent"], "SELECT doc_id, s, list_prepend(0::BIGINT, cum) AS cz, len(cum)::BIGINT AS n FROM sums JOIN sent USING (doc_id)"),
    "walk": (
        ["packed"],
        f"""SELECT doc_id, 0::BIGINT AS chunk_index, 1::BIGINT AS f,
              greatest(1, len(list_filter(cz, lambda c: c <= {SIZE})) - 1)::BIGINT AS e,
              0::BIGINT AS start_char, 0::BIGINT AS ov, n, cz FROM packed WHERE n > 0
            UNION ALL
            SELECT doc_id, chunk_index + 1, nf,
              greatest(e + 1, len(list_filter(cz, lambda c: c <= cz[nf] + {SIZE})) - 1)::BIGINT,
              start_char + (cz[e + 1] - cz[f] + e - f) - (cz[e + 1] - cz[nf]), cz[e + 1] - cz[nf], n, cz
            FROM (SELECT *, greatest(f, len(list_filter(cz, lambda c: c < cz[e + 1] - {OVERLAP})) + 1)::BIGINT AS nf
                  FROM walk WHERE e < n)""",
    ),
    "chunk": (
        ["walk", "packed"],
        "SELECT doc_id, chunk_index, start_char, start_char + length(body) AS end_char, ov AS overlap_chars, body AS text "
        "FROM (SELECT w.*, array_to_string(list_slice(p.s, w.f, w.e), ' ') AS body FROM walk w JOIN packed p USING (doc_id))",
    ),
    "chunk_id_rows": (["chunk"], f"SELECT *, {content_id('text')} AS chunk_id FROM chunk"),
    "blocks": (
        [],
        f"SELECT doc_id, i // {BLOCK} AS block_index, substr(text, i + 1, {BLOCK}) AS block FROM "
        f"(SELECT doc_id, text, unnest(range(0, length(text), {BLOCK})) AS i FROM documents)",
    ),
    "chunk_log": (
        ["chunk_id_rows"],
        "SELECT c.*, 0::BIGINT AS batch_id FROM chunk_id_rows c UNION ALL SELECT c.*, 1::BIGINT FROM chunk_id_rows c "
        "WHERE doc_id IN (SELECT doc_id FROM labels)",
    ),
    "once": (
        ["chunk_id_rows"],
        "SELECT * FROM chunk_id_rows QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY doc_id DESC, chunk_index DESC) = 1",
    ),
    "meta": (
        [],
        "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'doc_' || doc_id || '.html' END AS filename, source, lang FROM documents",
    ),
    # responses and what they hold
    "openings": (
        ["blocks"],
        f"SELECT doc_id, block_index, doc_id + block_index AS n, lang, source, list_transform({sentence_list('block')}, lambda x: lower(substr(x, 1, 3))) AS o "
        "FROM blocks JOIN documents USING (doc_id)",
    ),
    "bodies": (
        ["openings"],
        """SELECT doc_id, block_index, n,
          concat_ws(',', to_json({'name': source, 'type': 'source', 'description': 'documents in ' || lang}),
            to_json({'name': lang, 'type': 'language', 'description': 'language of ' || source}),
            nullif(array_to_string(list_transform(o, lambda x: to_json({'name': x, 'type': 'opening', 'description': 'in ' || lang})), ','), ''),
            CASE WHEN n % 5 = 0 THEN to_json({'name': source, 'type': 'source', 'description': 'again ' || source}) END,
            CASE WHEN n % 12 = 5 THEN '{"name":"no description","type":"x"}' END,
            CASE WHEN n % 12 = 6 THEN '{"name":7,"type":"x","description":"number"}' END) AS ents,
          concat_ws(',', to_json({'source': coalesce(o[1], 'untitled'), 'target': source, 'type': 'published_in'}),
            to_json({'source': coalesce(o[1], 'untitled'), 'target': lang, 'type': 'written_in'}),
            to_json({'source': source, 'target': lang, 'type': 'uses'}),
            nullif(array_to_string(list_transform(range(1, len(o)), lambda i: to_json({'source': o[i], 'target': o[i + 1], 'type': 'followed_by'})), ','), ''),
            CASE WHEN n % 3 = 0 THEN to_json({'source': coalesce(o[1], 'untitled'), 'target': 'Nowhere', 'type': 'mentions'}) END,
            CASE WHEN n % 4 = 0 THEN to_json({'source': coalesce(o[1], 'untitled'), 'target': source, 'type': 'published_in'}) END,
            to_json({'source': source, 'target': source, 'type': 'self'}),
            CASE WHEN n % 12 = 7 THEN '{"source":"x","type":"lost"},"loose",null' END,
            CASE WHEN n % 12 = 8 THEN '{"source":"x","target":3,"type":"number"}' END) AS rels
        FROM openings""",
    ),
    "responses": (
        ["bodies"],
        """SELECT doc_id, block_index, CASE n % 12 WHEN 1 THEN '```json' || chr(10) || body || chr(10) || '```' || chr(10) || 'see {above}'
          WHEN 2 THEN 'Here it is: ' || body || ' Done.' WHEN 3 THEN 'nothing found' WHEN 4 THEN '[' || body || ']'
          ELSE body END AS response
        FROM (SELECT doc_id, block_index, n, CASE n % 12 WHEN 9 THEN '{"entities":[' || ents || ']}'
          WHEN 10 THEN '{"entities":[' || ents || '],"relations":null}'
          WHEN 11 THEN '{"model":{"v":1},"entities":[' || ents || '],"relations":[' || rels || ']}'
          ELSE '{"entities":[' || ents || '],"relations":[' || rels || ']}' END AS body FROM bodies)""",
    ),
    "roots": (
        ["responses"],
        r"""SELECT doc_id, block_index, CASE WHEN json_valid(outer_text) THEN outer_text::JSON
          WHEN starts_with(response, '```') AND json_valid(inner_text) THEN inner_text::JSON END AS j
        FROM (SELECT doc_id, block_index, trim(response) AS response, nullif(regexp_extract(response, '(?s)\{.*\}'), '') AS outer_text,
          regexp_replace(trim(string_split(response, '```')[2], chr(10) || ' '), '^json', '') AS inner_text FROM responses)""",
    ),
    "listed": (
        ["roots"],
        """SELECT doc_id, block_index, CASE WHEN json_type(j, '$.entities') = 'ARRAY' THEN json_extract(j, '$.entities[*]') END AS es,
          CASE WHEN json_type(j, '$.relations') = 'ARRAY' THEN json_extract(j, '$.relations[*]') END AS rs FROM roots""",
    ),
    "kept": (
        ["listed"],
        """SELECT *, list_filter(rs, lambda r: json_exists(r, '$.source') AND json_exists(r, '$.target')
          AND json_exists(r, '$.type')) AS ks FROM listed""",
    ),
    "judged": (
        ["kept"],
        """SELECT *, coalesce(len(list_filter(es, lambda e: coalesce(json_type(e, '$.name') = 'VARCHAR'
              AND json_type(e, '$.type') = 'VARCHAR' AND json_type(e, '$.description') = 'VARCHAR', false))) = len(es)
            AND len(list_filter(ks, lambda r: coalesce(json_type(r, '$.source') = 'VARCHAR'
              AND json_type(r, '$.target') = 'VARCHAR' AND json_type(r, '$.type') = 'VARCHAR', false))) = len(ks), false) AS valid
        FROM kept""",
    ),
    "ent_rows": (
        ["judged"],
        """SELECT doc_id, block_index, pos, json_extract_string(e, '$.name') AS name,
          json_extract_string(e, '$.type') AS type, json_extract_string(e, '$.description') AS description
        FROM (SELECT doc_id, block_index, unnest(es) AS e, unnest(range(len(es))) AS pos FROM judged WHERE valid)""",
    ),
    "rel_rows": (
        ["judged"],
        """SELECT doc_id, block_index, pos, json_extract_string(r, '$.source') AS source, json_extract_string(r, '$.target') AS target,
          json_extract_string(r, '$.type') AS type
        FROM (SELECT doc_id, block_index, unnest(ks) AS r, unnest(range(len(ks))) AS pos FROM judged WHERE valid)""",
    ),
    "given_names": (
        ["ent_rows"],
        f"SELECT doc_id, block_index, name, arg_max({content_id(chr(34) + 'et' + chr(34))}, pos) AS entity_id FROM "
        "(SELECT *, name || ': ' || description AS et FROM ent_rows) GROUP BY doc_id, block_index, name",
    ),
    # entity graph of the order tables
    "ents": (
        [],
        """SELECT 'region/' || r_regionkey AS entity_id, r_name AS name, 'region' AS type, 'the region ' || r_name AS description FROM region
        UNION ALL SELECT 'nation/' || n_nationkey, n_name, 'nation', 'nation number ' || n_nationkey FROM nation
        UNION ALL SELECT 'supplier/' || s_suppkey, s_name, 'supplier', 'supplier in nation ' || s_nationkey FROM supplier
        UNION ALL SELECT 'part/' || p_partkey, p_name, 'part', p_brand || ' ' || p_type FROM part""",
    ),
    "rels": (
        [],
        """SELECT 'supplier/' || l_suppkey AS source_id, 'part/' || l_partkey AS target_id, 'supplies' AS type,
            (l_orderkey * 8 + l_linenumber) * 4194304 + l_partkey AS seq FROM lineitem
        UNION ALL SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey, 'located_in', 0 FROM supplier
        UNION ALL SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey, 'part_of', 1 FROM nation
        UNION ALL SELECT 'nation/' || n_nationkey, 'nation/' || (n_nationkey * 7 % 25), 'borders', 2 FROM nation
        UNION ALL SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey, 'lives_in', 3 FROM customer""",
    ),
    "edges": (["rels"], "SELECT source_id, target_id, type, min(seq) AS seq FROM rels GROUP BY ALL"),
    "adj": (
        ["edges"],
        "SELECT source_id, row_number() OVER (PARTITION BY source_id ORDER BY seq) - 1 AS position, target_id, type "
        "FROM edges WHERE source_id <> target_id",
    ),
    # vectors
    "centres": (
        [],
        "SELECT label::BIGINT AS query_id, list(x ORDER BY p) AS v FROM (SELECT label, p, avg(x) AS x FROM "
        "(SELECT label, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS p FROM embeddings) GROUP BY label, p) GROUP BY label",
    ),
    "centre_scores": (
        ["centres"],
        f"SELECT query_id, vec_id, {cosine('v', 'embedding')} AS score FROM centres CROSS JOIN embeddings",
    ),
    "vecs": ([], "SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS o, embedding AS v FROM embeddings"),
    "planes": (
        [],
        f"SELECT i, p, (x * x % {PM} * {P3} % {PM}) // 65536 % 2 * 2 - 1 AS c FROM (SELECT i, p, (i * {P1} + p * {P2} + {BANDS.seed}) % {PM} AS x "
        f"FROM (SELECT unnest(range((SELECT max(len(embedding)) FROM embeddings))) AS i) CROSS JOIN range({BANDS.bits * BANDS.bands}) t(p))",
    ),
    "sides": (
        ["planes"],
        "SELECT vec_id, p, sum(x * c) > 0 AS up FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, unnest(range(len(embedding))) AS i "
        "FROM embeddings) JOIN planes USING (i) GROUP BY vec_id, p",
    ),
    "band_keys": (
        ["sides"],
        f"SELECT vec_id, p // {BANDS.bits} AS band, sum(up::INT * 2 ** (p % {BANDS.bits})) AS sig FROM sides GROUP BY ALL",
    ),
    "candidates": (
        ["band_keys"],
        "SELECT DISTINCT a.vec_id AS vec_a, b.vec_id AS vec_b FROM band_keys a JOIN band_keys b USING (band, sig) WHERE a.vec_id < b.vec_id",
    ),
    # questions and hits
    "asked": ([], "SELECT item_id AS query_id, text AS query FROM benchmark"),
    "hit_scores": (
        ["asked_v", "once_v"],
        f"SELECT query_id, chunk_id, {cosine('a.v', 'c.v')} AS score FROM asked_v a CROSS JOIN once_v c",
    ),
    "hits": (
        ["hit_scores", "once", "meta"],
        "SELECT h.*, o.text, m.filename, m.source FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank "
        "FROM hit_scores QUALIFY rank <= 5) h JOIN once o USING (chunk_id) JOIN meta m USING (doc_id)",
    ),
    "contexts": (
        ["hits"],
        "SELECT query_id, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context_text, count(*) AS num_hits, max(score) AS best_score, "
        "string_agg(coalesce(nullif(filename, ''), nullif(source, ''), 'Unknown Source') || ': ' || text, chr(10) ORDER BY rank) AS context "
        "FROM hits GROUP BY query_id",
    ),
    # graph built from the responses
    "texts": (["ent_rows"], "SELECT *, name || ': ' || description AS et, row_number() OVER (ORDER BY doc_id, block_index, pos) - 1 AS ord FROM ent_rows"),
    "text_once": (["texts"], "SELECT et, min(ord) AS first_ord FROM texts GROUP BY et"),
    "text_order": (["text_once", "et_v"], "SELECT et, first_ord, v, row_number() OVER (ORDER BY first_ord) AS o FROM text_once JOIN et_v USING (et)"),
    "g_leaders": (
        ["g_led", "text_order", "texts"],
        "SELECT t.ord AS leader_ord, x.et, x.v, t.name, t.type, t.description, "
        f"{content_id('x.et || ' + quoted('#') + ' || t.doc_id || ' + quoted('/') + ' || t.block_index || ' + quoted('/') + ' || t.pos')} AS entity_id "
        "FROM g_led JOIN text_order x USING (o) JOIN texts t ON t.ord = x.first_ord",
    ),
    "g_match": (
        ["g_leaders", "text_order"],
        f"SELECT x.et, l.leader_ord, l.entity_id, {cosine('x.v', 'l.v')} AS s FROM text_order x JOIN g_leaders l "
        f"ON {cosine('x.v', 'l.v')} >= {queries.GRAPH_THRESHOLD}",
    ),
    "g_ids": (
        ["g_match", "texts"],
        "SELECT t.doc_id, t.block_index, t.pos, t.name, m.entity_id FROM texts t JOIN g_match m ON m.et = t.et AND m.leader_ord <= t.ord "
        "QUALIFY row_number() OVER (PARTITION BY t.ord ORDER BY (m.leader_ord = t.ord) DESC, m.s DESC, m.leader_ord) = 1",
    ),
    "g_names": (["g_ids"], "SELECT doc_id, block_index, name, arg_max(entity_id, pos) AS entity_id FROM g_ids GROUP BY ALL"),
    "g_edges": (
        ["g_names", "rel_rows"],
        "SELECT source_id, target_id, type, min(n) AS seq FROM (SELECT a.entity_id AS source_id, b.entity_id AS target_id, r.type, "
        "row_number() OVER (ORDER BY r.doc_id, r.block_index, r.pos) - 1 AS n FROM rel_rows r "
        "JOIN g_names a ON a.doc_id = r.doc_id AND a.block_index = r.block_index AND a.name = r.source "
        "JOIN g_names b ON b.doc_id = r.doc_id AND b.block_index = r.block_index AND b.name = r.target WHERE a.entity_id <> b.entity_id) GROUP BY ALL",
    ),
    "g_entries": (
        ["asked_v", "g_leaders"],
        f"SELECT query_id, entity_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, entity_id) AS rank FROM "
        f"(SELECT query_id, entity_id, {cosine('a.v', 'l.v')} AS score FROM asked_v a CROSS JOIN g_leaders l) "
        f"WHERE score >= {queries.ENTRY_THRESHOLD} QUALIFY rank <= 3",
    ),
    "g_lines": (
        ["g_entries", "g_leaders", "g_edges"],
        "SELECT query_id, rank, (-1)::BIGINT AS seq, 'Entity: ' || name || ' (' || type || ') - ' || description AS line "
        "FROM g_entries JOIN g_leaders USING (entity_id) UNION ALL "
        "SELECT query_id, rank, seq, '  - ' || d.type || ' -> ' || l.name FROM g_entries e JOIN g_edges d ON d.source_id = e.entity_id "
        "JOIN g_leaders l ON l.entity_id = d.target_id",
    ),
    "g_summary": (
        ["asked", "g_lines"],
        "SELECT query_id, coalesce(string_agg(line, chr(10) ORDER BY rank, seq), '') AS graph_summary "
        "FROM asked LEFT JOIN g_lines USING (query_id) GROUP BY query_id",
    ),
    "answers": (
        ["asked", "contexts", "g_summary"],
        "SELECT *, 'Context from documents:' || chr(10) || context_text || chr(10) || chr(10) || 'Knowledge graph context:' || chr(10) || "
        f"coalesce(nullif(graph_summary, ''), {quoted(extraction.NO_GRAPH)}) || chr(10) || chr(10) || 'Question: ' || query || chr(10) || chr(10) || "
        "'Answer based on the above context:' AS content FROM asked JOIN contexts USING (query_id) JOIN g_summary USING (query_id)",
    ),
    # linked sites
    "site": (
        [],
        f"""SELECT page_id, 'http://site' || (page_id // {SITE}) || '.example.org/p/' || i AS url,
          CASE WHEN i % 10 = 9 THEN '<html><body></body></html>' ELSE html || '<p><a class="x" href="/p/' || (2 * i + 1)
            || '">down</a><A HREF=''' || (2 * i + 2) || '''>down</A><a href=../p/0>home</a>'
            || '<a href="http://other.example.com/p/1">out</a><a href="/files/a.PDF">file</a>'
            || '<a href="#part">here</a><a name="none">no</a></p>' END AS html
        FROM (SELECT page_id, html, page_id % {SITE} AS i FROM pages)""",
    ),
    "site_texts": (["site"], f"SELECT page_id, url, html, {main_text('html')} AS text FROM site"),
}


def link_fragments(name: str, source: str) -> dict[str, tuple[list[str], str]]:
    href = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
    shown = f"regexp_replace(html, {quoted(tx.hidden_pattern(('script', 'style')))}, '', 'g')"
    raw = f"regexp_extract_all({shown}, {quoted(href)}, 1)"
    bare = "trim(regexp_replace(raw, {p}, '', 'g'))".format(p=quoted("^[\"']|[\"']$"))
    root = f"{part('url', 1)} || '://' || {part('url', 2)}"
    return {
        f"{name}_raw": ([source] if source in FRAGMENTS else [], f"SELECT page_id, url, unnest({raw}) AS raw, unnest(range(len({raw}))) AS pos FROM {source}"),
        f"{name}_ref": ([f"{name}_raw"], f"SELECT page_id, url, pos, {unescape(bare)} AS href FROM {name}_raw"),
        f"{name}_all": (
            [f"{name}_ref"],
            rf"""SELECT *, regexp_replace(CASE WHEN href = '' THEN url WHEN {part('href', 1)} <> '' THEN href
              WHEN starts_with(href, '//') THEN {part('url', 1)} || ':' || href
              WHEN starts_with(href, '/') THEN {root} || href
              WHEN starts_with(href, '?') THEN {root} || {part('url', 3)} || href
              WHEN starts_with(href, '#') THEN regexp_replace(url, '#.*$', '') || href
              WHEN starts_with(href, '../') THEN {root} || regexp_replace({part('url', 3)}, '[^/]*/[^/]*$', '') || substr(href, 4)
              ELSE {root} || regexp_replace({part('url', 3)}, '[^/]*$', '') || href END, '#$', '') AS link FROM {name}_ref""",
        ),
        f"{name}": ([f"{name}_all"], f"SELECT * FROM {name}_all WHERE {internal('link', part('url', 2))}"),
    }


FRAGMENTS |= link_fragments("page_links", "pages") | link_fragments("site_links", "site")
FRAGMENTS |= vectors("chunk_v", "chunk_keyed", "k", "text", 64)
FRAGMENTS["chunk_keyed"] = (["chunk"], "SELECT doc_id * 1048576 + chunk_index AS k, text FROM chunk")
FRAGMENTS |= vectors("once_v", "once", "chunk_id", "text", DIM)
FRAGMENTS |= vectors("asked_v", "asked", "query_id", "query", DIM)
FRAGMENTS |= vectors("et_v", "text_once", "et", "et", DIM)
FRAGMENTS |= leader_fragments("v", "vecs", "vec_id", queries.RESOLVE_THRESHOLD)
FRAGMENTS |= leader_fragments("g", "text_order", "et", queries.GRAPH_THRESHOLD)


def crawl_fragments(limit: int, depth: int = queries.CRAWL_DEPTH) -> dict[str, tuple[list[str], str]]:
    """The levels of a breadth-first crawl, spelled out."""
    key = "regexp_replace(u.url, '#.*$', '')"
    out = {
        f"c{limit}_q0": (["site"], "SELECT page_id AS crawl_id, url, 0::BIGINT AS parent, 0::BIGINT AS pos FROM site WHERE url LIKE '%/p/0'"),
    }
    seen, levels = [], []
    for d in range(depth + 1):
        done = " + ".join([f"(SELECT count(*) FROM c{limit}_r{e} x WHERE x.crawl_id = u.crawl_id)" for e in levels]) or "0"
        out[f"c{limit}_r{d}"] = (
            [f"c{limit}_q{d}", "site_texts", *[f"c{limit}_r{e}" for e in levels]],
            f"SELECT u.crawl_id, u.url, p.url AS page_url, {d}::BIGINT AS depth, p.text, row_number() OVER (PARTITION BY u.crawl_id ORDER BY parent, pos) + {done} AS rank "
            f"FROM c{limit}_q{d} u JOIN site_texts p ON p.url = {key} WHERE p.text <> '' QUALIFY rank <= {limit}",
        )
        levels.append(d)
        seen.append(f"SELECT crawl_id, url FROM c{limit}_q{d}")
        out[f"c{limit}_q{d + 1}"] = (
            [f"c{limit}_r{d}", "site_links"],
            f"SELECT crawl_id, link AS url, parent, pos FROM (SELECT r.crawl_id, CASE WHEN starts_with(href, '#') THEN r.page_url || href ELSE link END AS link, "
            f"r.rank AS parent, l.pos FROM c{limit}_r{d} r JOIN site_links l ON l.url = r.page_url) "
            f"WHERE (crawl_id, link) NOT IN ({' UNION ALL '.join(seen)}) "
            "QUALIFY row_number() OVER (PARTITION BY crawl_id, link ORDER BY parent, pos) = 1",
        )
    out[f"c{limit}"] = (
        [f"c{limit}_r{d}" for d in levels],
        " UNION ALL ".join(f"SELECT crawl_id, rank, depth, url, text FROM c{limit}_r{d}" for d in levels),
    )
    return out


FRAGMENTS |= crawl_fragments(queries.CRAWL_PAGES) | crawl_fragments(queries.CRAWL_LIMIT)
FRAGMENTS |= crawl_fragments(queries.WHOLE_PAGES, queries.WHOLE_DEPTH)


def chunk_fragments(prefix: str, needs: list[str], source: str) -> dict[str, tuple[list[str], str]]:
    """The chunk fragments once more, over the rows ``doc_id, text`` of another source."""
    names = ("sent", "sent_rows", "sums", "packed", "walk", "chunk")
    swap = {"documents": f"{prefix}_doc"} | {n: f"{prefix}_{n}" for n in names}
    out = {f"{prefix}_doc": (needs, source)}
    import re

    for name in names:
        deps, sql = FRAGMENTS[name]
        for old in ("documents", "sent_rows", "sent", "sums", "packed", "walk"):
            sql = re.sub(rf"\b(FROM|JOIN) {old}\b", rf"\1 {swap[old]}", sql)
        out[swap[name]] = ([swap[d] for d in deps] or [f"{prefix}_doc"], sql)
    return out


FRAGMENTS |= chunk_fragments("pc", [f"c{queries.WHOLE_PAGES}"], f"SELECT crawl_id * 1048576 + rank AS doc_id, text, url FROM c{queries.WHOLE_PAGES}")
FRAGMENTS["file_rows"] = (
    [],
    f"""SELECT doc_id, filename, file_type, CASE WHEN file_type IN ('.html', '.htm') THEN {main_text('content')} END AS text,
      CASE WHEN file_type IN ('', '.txt') THEN 'Unsupported file type: ' || file_type WHEN file_type = '.pdf' THEN 'No parser for .pdf' END AS error
    FROM (SELECT page_id AS doc_id, 'page ' || page_id || ' 100%' || e AS filename, lower(e) AS file_type,
      CASE WHEN page_id % 10 = 9 THEN '<html><body></body></html>' ELSE html END AS content
      FROM (SELECT *, CASE page_id % 7 WHEN 0 THEN '.PDF' WHEN 1 THEN '.htm' WHEN 2 THEN '.txt' WHEN 3 THEN '' ELSE '.html' END AS e FROM pages))""",
)
FRAGMENTS |= chunk_fragments("fc", ["file_rows"], "SELECT doc_id, coalesce(text, '') AS text FROM file_rows")


def sql(body: str, *needs: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for dep in FRAGMENTS[name][0]:
                visit(dep)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body

    def held(name: str) -> str:
        return "" if f"FROM {name} " in FRAGMENTS[name][1] else "MATERIALIZED "

    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {held(n)}({FRAGMENTS[n][1]})" for n in order) + "\n" + body


def oracle_sql() -> dict[str, str]:
    supported = ", ".join(quoted(s) for s in files.SUPPORTED)
    suffix = r"lower(regexp_extract(regexp_extract({0}, '([^/]*)/*$', 1), '^.+(\.[^.]+)$', 1))"
    tokens = "length({0}) // 4"
    out = {
        "ingest_text": sql(
            f"SELECT doc_id, 0::BIGINT AS chunk_index, 0::BIGINT AS start_char, length(text) AS end_char, source, {content_id('text')} AS chunk_id FROM documents"
        ),
        "ingest_files_filter": sql(
            f"""SELECT page_id, filename, file_type, file_type IN ({supported}) AS accepted,
              CASE WHEN file_type NOT IN ({supported}) THEN 'Unsupported file type: ' || file_type END AS error
            FROM (SELECT page_id, filename, {suffix.format('filename')} AS file_type FROM
              (SELECT page_id, CASE WHEN page_id % 11 <> 0 THEN 'in/' || regexp_extract(url, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1)
                || CASE page_id % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.txt' WHEN 2 THEN '' WHEN 3 THEN '.tar.html' WHEN 4 THEN '.Jpeg' ELSE '.md' END
                ELSE 'unknown' END AS filename FROM pages))"""
        ),
        "page_text": sql(f"SELECT page_id, url, {main_text('html')} AS text FROM pages"),
        "page_records": sql(
            "SELECT page_id, url, text, url AS source, 'web_page' AS type FROM site_texts WHERE text <> ''", "site_texts"
        ),
        "ingest_files": sql(
            """SELECT filename, file_type, coalesce(n, 0) AS num_chunks, length(r.text) AS total_characters,
              coalesce(error, CASE WHEN n IS NULL THEN 'No text found' END) AS error, chunk_index, start_char, end_char, c.text
            FROM file_rows r LEFT JOIN fc_chunk c USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM fc_chunk GROUP BY 1) USING (doc_id)""",
            "file_rows",
            "fc_chunk",
        ),
        "chunk_upsert": sql(
            """SELECT chunk_id, doc_id, chunk_index, start_char, end_char, batch_id, text, filename, chunk_index::VARCHAR AS meta_index
            FROM chunk_log JOIN meta USING (doc_id)
            QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY batch_id DESC, doc_id DESC, chunk_index DESC) = 1""",
            "chunk_log",
            "meta",
        ),
        "entity_upsert": sql(
            """SELECT * FROM (SELECT *, 0 AS l_orderkey, 0 AS l_linenumber, 0 AS l_partkey FROM ents UNION ALL SELECT 'supplier/' || l_suppkey,
              'Supplier ' || l_suppkey, 'supplier', 'last sold part ' || l_partkey, l_orderkey, l_linenumber, l_partkey FROM lineitem)
            QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC) = 1""",
            "ents",
        ),
        "entity_lookup": sql(
            "SELECT a.entity_id, name, type, description FROM (SELECT 'part/' || (p_partkey * 2) AS entity_id FROM part) a "
            "LEFT JOIN ents USING (entity_id)",
            "ents",
        ),
        "entity_payload_update": sql(
            """SELECT e.entity_id, name, type, CASE WHEN n % 2 = 0 THEN 'sold ' || n ELSE description END AS description
            FROM ents e LEFT JOIN (SELECT 'supplier/' || l_suppkey AS entity_id, count(*) AS n FROM lineitem GROUP BY 1) u USING (entity_id)""",
            "ents",
        ),
        "sentences": sql("SELECT doc_id, pos, sentence FROM sent_rows", "sent_rows"),
        "chunks": sql("SELECT * FROM chunk", "chunk"),
        "chunk_metadata": sql(
            "SELECT doc_id, chunk_index, filename, source, lang, chunk_index::VARCHAR AS meta_index FROM chunk JOIN meta USING (doc_id)",
            "chunk",
            "meta",
        ),
        "text_blocks": sql("SELECT * FROM blocks", "blocks"),
        "reassemble_text": sql(
            "SELECT doc_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS full_text FROM chunk GROUP BY doc_id", "chunk"
        ),
        "chunk_ids": sql("SELECT doc_id, chunk_index, chunk_id FROM chunk_id_rows", "chunk_id_rows"),
        "embed_text": sql(
            "SELECT k // 1048576 AS doc_id, k % 1048576 AS chunk_index, "
            "array_to_string(list_transform(v, lambda x: round(x::DOUBLE * 10000)::BIGINT), ',') AS embedding FROM chunk_v",
            "chunk_v",
        ),
        "entity_text": sql("SELECT entity_id, name || ': ' || description AS entity_text FROM ents", "ents"),
        "extraction_prompts": sql(
            f"SELECT doc_id, block_index, 'system' AS first_role, {quoted(extraction.EXTRACTION_RULES)} AS rules, 'user' AS second_role, "
            "'Extract from:' || chr(10) || chr(10) || block AS content FROM blocks",
            "blocks",
        ),
        "approx_tokens": sql(f"SELECT conv_id, turn, {tokens.format('text')} AS tokens FROM conversations"),
        "parse_extractions": sql(
            """SELECT doc_id, block_index, valid, coalesce(ne, 0) AS num_entities, coalesce(nr, 0) AS num_relations,
              coalesce(es, '') AS entities, coalesce(rs, '') AS relations FROM (SELECT doc_id, block_index, valid FROM judged)
            LEFT JOIN (SELECT doc_id, block_index, count(*) AS ne, string_agg(concat_ws('|', name, type, description), ';' ORDER BY pos) AS es
              FROM ent_rows GROUP BY doc_id, block_index) USING (doc_id, block_index)
            LEFT JOIN (SELECT doc_id, block_index, count(*) AS nr, string_agg(concat_ws('|', source, target, type), ';' ORDER BY pos) AS rs
              FROM rel_rows GROUP BY doc_id, block_index) USING (doc_id, block_index)""",
            "judged",
            "ent_rows",
            "rel_rows",
        ),
        "malformed_relations": sql("SELECT doc_id, block_index, len(rs) - len(ks) AS dropped FROM kept WHERE len(rs) > len(ks)", "kept"),
        "similarity_join": sql(
            f"SELECT vec_a, vec_b, round(score, 6) AS score FROM (SELECT a.vec_id AS vec_a, b.vec_id AS vec_b, {cosine('a.embedding', 'b.embedding')} AS score "
            f"FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id) WHERE score >= {queries.PAIR_THRESHOLD}"
        ),
        "similarity_join_lsh": sql(
            f"SELECT vec_a, vec_b, round(score, 6) AS score FROM (SELECT vec_a, vec_b, {cosine('a.embedding', 'b.embedding')} AS score FROM candidates "
            f"JOIN embeddings a ON a.vec_id = vec_a JOIN embeddings b ON b.vec_id = vec_b) WHERE score >= {queries.PAIR_THRESHOLD}",
            "candidates",
        ),
        "score_threshold": sql(
            f"SELECT query_id, vec_id, round(score, 6) AS score FROM centre_scores WHERE score >= {queries.PAIR_THRESHOLD}", "centre_scores"
        ),
        "topk_entities": sql(
            f"""SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, round(score, 6) AS score
            FROM centre_scores WHERE score >= {queries.PAIR_THRESHOLD} QUALIFY rank <= 3""".replace("round(score, 6) AS score", "round(centre_scores.score, 6) AS score"),
            "centre_scores",
        ),
        "nearest_entity": sql(
            f"""SELECT query_id, vec_id, round(s, 6) AS score FROM (SELECT query_id, vec_id, score AS s FROM centre_scores
            WHERE score >= {queries.RESOLVE_THRESHOLD}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) = 1""",
            "centre_scores",
        ),
        "topk_chunks": sql("SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits", "hits"),
        "topk_limits": sql(
            "SELECT query_id, rank, chunk_id, round(score, 6) AS score FROM hits WHERE rank <= 1 + query_id % 5", "hits"
        ),
        "ingest_documents": sql(
            "SELECT o.chunk_id, doc_id, chunk_index, source, o.text, "
            "array_to_string(list_transform(v, lambda x: round(x::DOUBLE * 10000)::BIGINT), ',') AS embedding "
            "FROM once o JOIN once_v USING (chunk_id) JOIN meta USING (doc_id)",
            "once",
            "once_v",
            "meta",
        ),
        "ingest_urls": sql(
            f"""SELECT chunk_id, crawl_id AS doc_id, rank, chunk_index, url AS source, 'web_page' AS type, depth::VARCHAR AS depth, text
            FROM (SELECT {content_id('c.text')} AS chunk_id, d.doc_id // 1048576 AS crawl_id, d.doc_id % 1048576 AS rank, chunk_index, d.url, c.text
              FROM pc_chunk c JOIN pc_doc d ON d.doc_id = c.doc_id
              QUALIFY row_number() OVER (PARTITION BY c.text ORDER BY d.doc_id DESC, chunk_index DESC) = 1)
            JOIN (SELECT crawl_id, rank, depth FROM c{queries.WHOLE_PAGES}) USING (crawl_id, rank)""",
            "pc_chunk",
            f"c{queries.WHOLE_PAGES}",
        ),
        "ordered_context": sql("SELECT query_id, rank, text FROM hits ORDER BY query_id, rank", "hits"),
        "context_concat": sql("SELECT query_id, context_text, num_hits FROM contexts", "contexts"),
        "hit_payload": sql(
            "SELECT query_id, rank, text, round(score, 6) AS score, true AS text_in_payload, source FROM hits", "hits"
        ),
        "source_label": sql(
            "SELECT query_id, rank, coalesce(nullif(filename, ''), nullif(source, ''), 'Unknown Source') AS label, printf('%.2f', score) AS score_label FROM hits",
            "hits",
        ),
        "relation_resolution": sql(
            """SELECT r.doc_id, r.block_index, r.pos, a.entity_id AS source_id, b.entity_id AS target_id, r.type FROM rel_rows r
            JOIN given_names a ON a.doc_id = r.doc_id AND a.block_index = r.block_index AND a.name = r.source JOIN given_names b ON b.doc_id = r.doc_id AND b.block_index = r.block_index AND b.name = r.target""",
            "given_names",
            "rel_rows",
        ),
        "unresolved_relations": sql(
            """SELECT r.*, a.name IS NOT NULL AS source_known, b.name IS NOT NULL AS target_known FROM rel_rows r
            LEFT JOIN given_names a ON a.doc_id = r.doc_id AND a.block_index = r.block_index AND a.name = r.source
            LEFT JOIN given_names b ON b.doc_id = r.doc_id AND b.block_index = r.block_index AND b.name = r.target WHERE a.name IS NULL OR b.name IS NULL""",
            "given_names",
            "rel_rows",
        ),
        "self_loops": sql(
            "SELECT source_id, target_id, type, count(*) AS copies FROM rels WHERE source_id <> target_id GROUP BY ALL", "rels"
        ),
        "missing_source": sql(
            "SELECT type, count(*) AS kept, count(DISTINCT source_id) AS sources FROM rels WHERE source_id IN (SELECT entity_id FROM ents) GROUP BY type",
            "rels",
            "ents",
        ),
        "existing_semi_join": sql(
            "SELECT source_id, target_id, type FROM edges WHERE source_id IN (SELECT entity_id FROM ents)", "edges", "ents"
        ),
        "existing_anti_join": sql(
            "SELECT source_id, target_id, type FROM edges EXCEPT SELECT source_id, target_id, type FROM rels WHERE md5(source_id || target_id || type) < '8'",
            "edges",
            "rels",
        ),
        "edge_union_distinct": sql(
            "SELECT source_id, target_id, type FROM rels WHERE type <> 'borders' UNION "
            "SELECT source_id, target_id, type FROM rels WHERE type <> 'located_in'",
            "rels",
        ),
        "adjacency": sql("SELECT * FROM adj", "adj"),
        "one_hop_neighbours": sql(
            """SELECT e.source_id, s.name AS source_name, e.type, e.target_id, t.name AS target_name FROM edges e
            JOIN ents s ON s.entity_id = e.source_id JOIN ents t ON t.entity_id = e.target_id WHERE s.type IN ('supplier', 'nation')""",
            "edges",
            "ents",
        ),
        "graph_context_lines": sql(
            """SELECT entity_id AS query_id, (-1)::BIGINT AS seq, 'Entity: ' || name || ' (' || type || ') - ' || description AS line FROM ents
            UNION ALL SELECT source_id, seq, '  - ' || a.type || ' -> ' || t.name FROM edges a JOIN ents s ON s.entity_id = source_id
            JOIN ents t ON t.entity_id = target_id WHERE source_id <> target_id""",
            "edges",
            "ents",
        ),
        "resolve_entities": sql(
            """SELECT a.vec_id, coalesce(m.vec_id, a.vec_id) AS leader_vec_id, round(coalesce(m.s, 1.0), 6) AS score FROM vecs a
            LEFT JOIN (SELECT j, l.vec_id, s FROM v_sim JOIN vecs l ON l.o = i WHERE i IN (SELECT o FROM v_led) AND j NOT IN (SELECT o FROM v_led)
              QUALIFY row_number() OVER (PARTITION BY j ORDER BY s DESC, i) = 1) m ON m.j = a.o""",
            "v_led",
            "v_sim",
        ),
        "build_graph": sql(
            """SELECT source_id, target_id, e.type, a.name AS source_name, b.name AS target_name, seq FROM g_edges e
            JOIN g_leaders a ON a.entity_id = source_id JOIN g_leaders b ON b.entity_id = target_id""",
            "g_edges",
        ),
        "graph_context": sql("SELECT query_id, graph_summary FROM g_summary", "g_summary"),
        "answer_prompts": sql(f"SELECT query_id, {quoted(extraction.ANSWER_RULES)} AS rules, content FROM answers", "answers"),
        "hybrid_query": sql(
            f"""SELECT query_id, query, num_hits, round(best_score, 6) AS best_score, context_text, context, graph_summary,
              {tokens.format('content')} AS prompt_tokens FROM answers""".replace("round(best_score, 6)", "round(answers.best_score, 6)"),
            "answers",
        ),
        "doc_stats": sql(
            f"""SELECT d.doc_id, filename, {suffix.format('filename')} AS file_type, length(text) AS total_characters, coalesce(n, 0) AS num_chunks
            FROM documents d JOIN meta USING (doc_id) LEFT JOIN (SELECT doc_id, count(*) AS n FROM chunk GROUP BY 1) USING (doc_id)""",
            "chunk",
            "meta",
        ),
        "ingest_summary": sql(
            "SELECT source, count(DISTINCT doc_id) AS processed, count(*) AS num_chunks, 'success' AS status FROM chunk JOIN meta USING (doc_id) GROUP BY source",
            "chunk",
            "meta",
        ),
        "token_usage": sql(
            """SELECT u.conv_id, count(*) AS calls, sum(length(u.text) // 4)::BIGINT AS input_tokens,
              sum(coalesce(length(a.text) // 4, 0))::BIGINT AS output_tokens, sum(length(u.text) // 4 + coalesce(length(a.text) // 4, 0))::BIGINT AS total_tokens,
              max(length(u.text) // 4) AS largest_input
            FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant'
            WHERE u.role = 'user' GROUP BY u.conv_id"""
        ),
        "duplicate_report": sql(
            """SELECT chunk_id, count(*) AS copies, min(doc_id) AS first_doc_id, max(doc_id) AS last_doc_id,
              arg_min(chunk_index, (doc_id, chunk_index)) AS first_chunk_index, arg_max(chunk_index, (doc_id, chunk_index)) AS last_chunk_index
            FROM chunk_id_rows GROUP BY chunk_id""",
            "chunk_id_rows",
        ),
        "latest_version": sql(
            "SELECT user_id, event_id, event_type, round(events.value, 6) AS value FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1"
        ),
        "chunk_offsets": sql("SELECT doc_id, chunk_index, overlap_chars, start_char FROM chunk", "chunk"),
        "extract_links": sql("SELECT page_id, url, pos, href, link FROM page_links", "page_links"),
        "internal_links": sql("SELECT page_id, pos, link FROM site_links", "site_links"),
        "invalid_start_url": sql(
            f"""SELECT page_id, url, 'Invalid start URL: ' || url AS error FROM (SELECT page_id, url FROM pages
            UNION ALL SELECT page_id, {part('url', 3)} FROM pages) WHERE {part('url', 2)} = ''"""
        ),
        "link_page_join": sql(
            "SELECT l.page_id, l.pos, l.link, p.page_id AS target_page_id FROM site_links l JOIN site p ON p.url = regexp_replace(l.link, '#.*$', '')",
            "site_links",
            "site",
        ),
        "visited_distinct": sql("SELECT DISTINCT link FROM site_links", "site_links"),
        "crawl_pages": sql(
            f"SELECT crawl_id, rank, depth, url, length(text) AS chars FROM c{queries.CRAWL_PAGES}", f"c{queries.CRAWL_PAGES}"
        ),
        "crawl_limit": sql(f"SELECT crawl_id, rank, depth, url FROM c{queries.CRAWL_LIMIT}", f"c{queries.CRAWL_LIMIT}"),
        "combine_pages": sql(
            f"SELECT crawl_id, string_agg(text, chr(10) || chr(10) || '---PAGE BREAK---' || chr(10) || chr(10) ORDER BY rank) AS full_text FROM c{queries.WHOLE_PAGES} GROUP BY crawl_id",
            f"c{queries.WHOLE_PAGES}",
        ),
        "union_page_chunks": sql(
            "SELECT d.doc_id // 1048576 AS crawl_id, d.doc_id % 1048576 AS rank, url, chunk_index, start_char, c.text FROM pc_chunk c JOIN pc_doc d ON d.doc_id = c.doc_id",
            "pc_chunk",
        ),
        "stream_ingest": sql(
            "SELECT chunk_id, doc_id, chunk_index, start_char, end_char, text, filename FROM once JOIN meta USING (doc_id)", "once", "meta"
        ),
        "quota_flags": sql(
            f"""SELECT event_id, user_id, date_trunc('minute', ts) AS window_start,
              row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) > {queries.QUOTA} AS over_limit FROM events"""
        ),
        "quota_counts": sql(
            f"SELECT user_id, date_trunc('minute', ts) AS window_start, count(*) AS requests, greatest(count(*) - {queries.QUOTA}, 0) AS rejected FROM events GROUP BY 1, 2"
        ),
        "apply_model": sql(
            """SELECT doc_id, block_index, CASE WHEN n % 7 <> 0 THEN 'chars=' || n END AS response,
              CASE WHEN n % 7 = 0 THEN 'ValueError: prompt refused' END AS error
            FROM (SELECT doc_id, block_index, length(block) + 15 AS n FROM blocks)""",
            "blocks",
        ),
    }
    out["chunk_merge"] = out["chunk_upsert"]
    out["stream_latest"], out["stream_quota"] = out["latest_version"], out["quota_flags"]
    for name in ("similarity_join", "topk_chunks", "nearest_entity", "resolve_entities"):
        out[f"{name}_tiled"] = out[name]
    return out
