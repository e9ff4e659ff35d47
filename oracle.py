"""DuckDB SQL that answers the registered queries on the same Parquet tables.

The statements are built from named CTEs; each query lists the ones it needs.
"""

from __future__ import annotations

from pagetrove.config import LINK_DENY_LIST, RankWeights
from pagetrove.functions import text as t
from pagetrove.functions import urls as u
from pagetrove.operators.embed import WORD_BREAK
from pagetrove.operators.links import HREF
from pagetrove.operators.vectors import LshIndex

W = RankWeights()
K = 100
DIMS = 384


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def sub_all(expr: str, pattern: str, to: str = "''") -> str:
    return f"regexp_replace({expr}, {lit(pattern)}, {to}, 'g')"


def extract(expr: str, pattern: str) -> str:
    return f"regexp_extract({expr}, {lit(pattern)}, 1)"


def trim_blank(expr: str) -> str:
    codes = " || ".join(f"chr({ord(c)})" for c in t.BLANK_CHARS)
    return f"trim({expr}, {codes})"


def decode(expr: str) -> str:
    """Needs ``entities`` in the FROM clause."""
    name = "regexp_extract(p, '^(#?[A-Za-z0-9]{1,31});', 1)"
    char = f"""CASE WHEN regexp_matches({name}, '^#[xX][0-9A-Fa-f]{{1,6}}$') THEN chr(('0x' || substr({name}, 3))::INT)
                WHEN regexp_matches({name}, '^#[0-9]{{1,7}}$') THEN chr(substr({name}, 2)::INT)
                ELSE entities.m[{name}] END"""
    pieces = f"string_split({expr}, '&')"
    return f"""(CASE WHEN contains({expr}, '&') THEN {pieces}[1] || array_to_string(list_transform({pieces}[2:],
        lambda p: coalesce({char} || substr(p, length({name}) + 2), '&' || p)), '') ELSE {expr} END)"""


def host(expr: str) -> str:
    return f"lower(nullif({extract(expr, u.HOST_PATTERN)}, ''))"


def encode_unsafe(expr: str) -> str:
    return f"""array_to_string(list_transform(string_split({expr}, ''),
        lambda c: CASE WHEN regexp_matches(c, {lit(u.UNSAFE_CHAR)}) THEN url_encode(c) ELSE c END), '')"""


def path_of(expr: str) -> str:
    return f"coalesce(nullif({encode_unsafe(extract(expr, u.PATH_PATTERN))}, ''), '/')"


def site(expr: str) -> str:
    return f"array_to_string(string_split(regexp_replace({expr}, '^www\\.', ''), '.')[-2:], '.')"


def has_tail(expr: str) -> str:
    return f"({extract(expr, u.QUERY_PATTERN)} <> '' OR {extract(expr, u.FRAGMENT_PATTERN)} <> '')"


def breadcrumb(expr: str) -> str:
    longer = "CASE WHEN p = '' THEN s.txt ELSE s.txt || ' › ' || p END"
    ends = "(s.done OR regexp_matches(p, '\\.(html|htm|php|asp)$'))"
    return f"""list_reduce(string_split({path_of(expr)}, '/')[1:3],
        lambda s, p: {{'txt': CASE WHEN {ends} THEN s.txt WHEN length({longer}) > 50 THEN s.txt || ' › ...' ELSE {longer} END,
                       'done': {ends} OR length({longer}) > 50}},
        {{'txt': {host(expr)}, 'done': false}}).txt"""


def clean_paras(expr: str, separator: str) -> str:
    one = f"regexp_replace(regexp_replace({trim_blank('p')}, chr(9), ' '), '  ', ' ')"
    return f"list_filter(list_transform(string_split({expr}, {separator}), lambda p: {one}), lambda p: p <> '')"


def merge(expr: str) -> str:
    single = f"length(regexp_extract_all(p, {lit(t.SENTENCE_BREAK)})) = 0"
    return f"""list_reduce({expr}, lambda s, p: {{
        'done': CASE WHEN s.held IS NULL AND {single} THEN s.done
                     ELSE list_append(s.done, CASE WHEN s.held IS NULL THEN p ELSE s.held || chr(10) || p END) END,
        'held': CASE WHEN s.held IS NULL AND {single} THEN p ELSE NULL END}},
        {{'done': []::VARCHAR[], 'held': NULL::VARCHAR}})"""


def finish_merge(state: str) -> str:
    return f"CASE WHEN {state}.held IS NULL THEN {state}.done ELSE list_append({state}.done, {state}.held) END"


def pack(expr: str) -> str:
    full = "length(s.cur) + length(p) > 1000"
    return f"""list_reduce({expr}, lambda s, p: {{
        'done': CASE WHEN {full} THEN list_append(s.done, s.cur) ELSE s.done END,
        'cur': CASE WHEN {full} THEN '' ELSE s.cur END || p || chr(10)}},
        {{'done': []::VARCHAR[], 'cur': ''}})"""


def finish_pack(state: str) -> str:
    return f"CASE WHEN length({state}.cur) > 5 THEN list_append({state}.done, {state}.cur) ELSE {state}.done END"


def chunks_of(source: str, separator: str, columns: str) -> dict[str, str]:
    """CTEs ``paras``, ``merged`` and ``packed`` over ``source(columns, text)``."""
    return {
        "paras": f"SELECT {columns}, {clean_paras('text', separator)} AS paragraphs FROM {source}",
        "merging": f"SELECT *, {merge('paragraphs')} AS m FROM paras",
        "merged": f"SELECT {columns}, {finish_merge('m')} AS merged FROM merging",
        "packing": f"SELECT *, {pack('merged')} AS k FROM merged",
        "packed": f"SELECT {columns}, {finish_pack('k')} AS chunks FROM packing",
    }


def with_ctes(ctes: dict[str, str], body: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS {'' if n in ('cut_runs', 'reached') else 'MATERIALIZED '}({q})" for n, q in ctes.items()) + "\n" + body


def article_ctes() -> dict[str, str]:
    names = ", ".join(lit(n) for n in t.ENTITIES)
    chars = ", ".join(lit(c) for c in t.ENTITIES.values())
    containers = ", ".join(f"nullif({extract('body', c)}, '')" for c in t.CONTAINERS)
    meta = lambda p: sub_all(extract("clean", p), t.QUOTES)
    site_names = ", ".join(f"nullif({meta(p)}, '')" for p in t.META_SITE_NAME)
    broken = f"regexp_replace(article, {lit(t.BLOCK_ENDS)}, chr(10) || chr(10), 'g')"
    stripped = sub_all(broken, t.ANY_TAG)
    first_p = sub_all(extract("article", t.FIRST_PARAGRAPH), t.ANY_TAG)
    summaries = ", ".join(
        f"nullif({trim_blank(e)}, '')"
        for e in (*map(meta, t.META_DESCRIPTION), first_p)
    )
    return {
        "entities": f"SELECT MAP([{names}], [{chars}]) AS m",
        "cleaned": f"SELECT page_id, url, {sub_all('html', t.SCRIPTS)} AS clean FROM pages",
        "bodies": f"SELECT *, {sub_all('clean', t.HEAD_AND_DRAWINGS)} AS body FROM cleaned",
        "blocks": f"SELECT *, {sub_all(f'coalesce({containers}, body)', t.SIDE_BLOCKS)} AS article FROM bodies",
        "raw": f"""SELECT *, array_to_string(regexp_extract_all(clean, {lit(t.TITLE)}, 1), '') AS raw_title,
                   {stripped} AS raw_text, coalesce({summaries}) AS raw_summary FROM blocks""",
        "articles": f"""SELECT page_id, url, {host('url')} AS host, {decode('raw_title')} AS title,
                        nullif({trim_blank(decode('raw_summary'))}, '') AS summary,
                        coalesce({site_names}) AS sitename,
                        {decode('raw_text')} AS text FROM raw, entities""",
    }


def dense_ctes() -> dict[str, str]:
    """CTE ``decoded(page_id, text)``: the run of blocks of the most worth, by sums up to each block."""
    links = f"array_to_string(list_transform(regexp_extract_all(b, {lit(t.ANCHOR)}, 1), lambda a: {sub_all('a', t.ANY_TAG)}), '')"
    body = f"regexp_replace({sub_all(sub_all('html', t.SCRIPTS), t.HEAD_AND_DRAWINGS)}, {lit(t.BLOCK_TAG)}, chr(1), 'g')"
    return {
        "entities": article_ctes()["entities"],
        "numbered": """SELECT page_id * 2 AS page_id, html FROM pages UNION ALL
                       SELECT page_id * 2 + 1, regexp_replace(html, '(?i)</?(article|main)[^>]*>', '', 'g') FROM pages""",
        "pieces": f"""SELECT page_id, generate_subscripts(bs, 1) AS pos, unnest(bs) AS b FROM (SELECT page_id, string_split({body}, chr(1)) AS bs FROM numbered)""",
        "measured": f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS n, txt,
                        length(txt) - {t.LINK_COST} * length({links}) - {t.BLOCK_COST} AS worth
                        FROM (SELECT *, {trim_blank(sub_all('b', t.ANY_TAG))} AS txt FROM pieces) WHERE txt <> ''""",
        "summed": "SELECT *, sum(worth) OVER (PARTITION BY page_id ORDER BY n) AS upto FROM measured",
        "least": "SELECT *, min(upto - worth) OVER (PARTITION BY page_id ORDER BY n) AS low FROM summed",
        "ends": "SELECT page_id, n AS last, low FROM least WHERE upto > low QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY upto - low DESC, n) = 1",
        "runs_of_blocks": """SELECT e.page_id, e.last, min(s.n) AS first FROM ends e JOIN summed s ON s.page_id = e.page_id AND s.n <= e.last AND s.upto - s.worth = e.low
                             GROUP BY ALL""",
        "joined": """SELECT page_id, string_agg(txt, chr(10) || chr(10) ORDER BY n) AS raw FROM measured JOIN runs_of_blocks USING (page_id)
                     WHERE n BETWEEN first AND last GROUP BY 1""",
        "decoded": f"SELECT page_id, {decode('raw')} AS text FROM joined, entities",
    }


def parsed_ctes() -> dict[str, str]:
    columns = "page_id, url, host, title, summary"
    return article_ctes() | chunks_of("articles", "chr(10) || chr(10)", columns) | {
        "parsed": f"""SELECT {columns}, chunks, sha256(array_to_string(chunks, chr(10))) AS hash
                      FROM packed WHERE len(chunks) > 0""",
    }


def store_ctes() -> dict[str, str]:
    """Page addresses are unique in the table, so first per content is the sequential answer."""
    return parsed_ctes() | {
        "stored": "SELECT * FROM parsed QUALIFY row_number() OVER (PARTITION BY hash ORDER BY page_id) = 1",
        "numbered": "SELECT url, title, len(chunks) AS n, unnest(chunks) AS body, generate_subscripts(chunks, 1) AS i FROM stored",
        "chunk_rows": """SELECT sha256(url || '-' || i) AS id, url || '-' || i AS pid, url,
                         title || ' part ' || i || ' of ' || n || ' (' || url || '):' || chr(10) || body AS chunk FROM numbered""",
    }


def embed_ctes(source: str, key: str, text: str, prefix: str) -> dict[str, str]:
    """``<prefix>_w(key, dim, w)``: the non-zero components of each text's vector."""
    return {
        f"{prefix}_words": f"""SELECT {key}, unnest(list_filter(string_split_regex(lower({text}), {lit(WORD_BREAK)}),
                               lambda w: w <> '')) AS word FROM {source}""",
        f"{prefix}_codes": f"SELECT {key}, ('0x' || substr(md5(word), 1, 5))::INT AS code FROM {prefix}_words",
        f"{prefix}_sums": f"""SELECT {key}, (code // 16) % {DIMS} AS dim, sum(CASE WHEN code % 16 < 8 THEN 1 ELSE -1 END)::DOUBLE AS s
                              FROM {prefix}_codes GROUP BY 1, 2""",
        f"{prefix}_w": f"""SELECT {key}, dim, (s / sqrt(sum(s * s) OVER (PARTITION BY {key})))::FLOAT::DOUBLE AS w
                           FROM {prefix}_sums WHERE s <> 0""",
    }


def search_ctes() -> dict[str, str]:
    """Every page title is a query against all chunks."""
    norms = lambda p, key: f"SELECT {key}, sqrt(sum(w * w)) AS norm FROM {p}_w GROUP BY 1"
    return store_ctes() | {
        "queries": f"SELECT page_id AS qid, trim(title) AS q FROM articles WHERE trim(title) <> ''",
    } | embed_ctes("chunk_rows", "pid", "chunk", "c") | embed_ctes("queries", "qid", "q", "q") | {
        "c_norm": norms("c", "pid"), "q_norm": norms("q", "qid"),
        "dots": "SELECT qid, pid, sum(q_w.w * c_w.w) AS dot FROM q_w JOIN c_w USING (dim) GROUP BY 1, 2",
        "scores": """SELECT qid, pid, round(coalesce(dot / (norm_q * norm_c), 0), 12) + 0 AS score
                     FROM (SELECT queries.qid, chunk_rows.pid, q_norm.norm AS norm_q, c_norm.norm AS norm_c
                           FROM queries CROSS JOIN chunk_rows LEFT JOIN q_norm USING (qid) LEFT JOIN c_norm USING (pid))
                     LEFT JOIN dots USING (qid, pid)""",
        "matches": f"SELECT * REPLACE (round(score, 6) + 0 AS score) FROM scores QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) <= {K}",
        "results": """SELECT qid, q, pid, url, title, chunk, summary, score FROM matches JOIN chunk_rows USING (pid)
                      JOIN stored USING (url) JOIN queries USING (qid)""".replace("stored USING", "(SELECT url, title, summary FROM stored) s USING"),
        "best": """SELECT * FROM results
                   QUALIFY row_number() OVER (PARTITION BY qid, lower(url) ORDER BY score DESC, pid) = 1""",
        "deduped": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS base_rank FROM best",
    }


def words(expr: str) -> str:
    return f"trim({sub_all(f'lower({expr})', '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}]', lit(' '))})"


def contains_ratio(text: str) -> str:
    return f"CASE WHEN {words('q')} <> '' AND contains({words(text)}, {words('q')}) THEN 100 ELSE 0 END"


def levenshtein_ratio(text: str) -> str:
    ascii_words = lambda e: f"trim({sub_all(f'lower({e})', '[^a-z0-9]', lit(' '))})"
    a, b = ascii_words(text), ascii_words("q")
    short, long_ = f"CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END", f"CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END"
    return f"""(SELECT CASE WHEN length(x.s) = 0 THEN 0 ELSE list_max(list_transform(range(1, length(x.l) - length(x.s) + 2),
        lambda i: floor((length(x.s) - levenshtein(substr(x.l, i, length(x.s)), x.s)) * 100 / length(x.s))))::INT END
        FROM (SELECT {short} AS s, {long_} AS l) x)"""


def partial_ctes(pairs: str) -> dict[str, str]:
    """CTE ``partial(a, b, ratio)`` of the distinct pairs of cleaned texts that ``pairs`` selects.

    Ratios of up to the cutoff are left out. Each level of ``cut_runs`` takes the longest run of equal
    characters of a region as a block and cuts the other runs to the regions on both sides of it; the
    longest common subsequence of a window is the longest rising sequence of its places.
    """
    cut = W.fuzzy_cutoff + 0.5
    return {
        "given": f"SELECT DISTINCT a, b FROM ({pairs}) WHERE a <> '' AND b <> ''",
        "sided": """SELECT row_number() OVER () AS pair, a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS s,
                    CASE WHEN length(a) <= length(b) THEN b ELSE a END AS l FROM given""",
        "s_counts": "SELECT s, c, count(*) AS n FROM (SELECT DISTINCT s, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) AS i FROM sided) GROUP BY 1, 2",
        "l_counts": "SELECT l, c, count(*) AS n FROM (SELECT DISTINCT l, unnest(string_split(l, '')) AS c, generate_subscripts(string_split(l, ''), 1) AS j FROM sided) GROUP BY 1, 2",
        "bound": """SELECT pair, sum(least(a.n, b.n)) AS most FROM sided JOIN s_counts a ON a.s = sided.s
                    JOIN l_counts b ON b.l = sided.l AND b.c = a.c GROUP BY 1""",
        "likely": f"SELECT sided.* FROM sided JOIN bound USING (pair) WHERE 200 * most >= {cut} * (length(s) + most)",
        "s_chars": "SELECT s, unnest(string_split(s, '')) AS c, generate_subscripts(string_split(s, ''), 1) - 1 AS i FROM (SELECT DISTINCT s FROM likely)",
        "l_chars": "SELECT l, unnest(string_split(l, '')) AS c, generate_subscripts(string_split(l, ''), 1) - 1 AS j FROM (SELECT DISTINCT l FROM likely)",
        "places": "SELECT pair, i, j FROM likely JOIN s_chars x ON x.s = likely.s JOIN l_chars y ON y.l = likely.l AND y.c = x.c",
        "runs": """SELECT pair, min(i) AS i, min(j) AS j, count(*) AS n FROM (
                   SELECT *, i - row_number() OVER (PARTITION BY pair, j - i ORDER BY i) AS g FROM places) GROUP BY pair, j - i, g""",
        "cut_runs": """SELECT pair, 0 AS level, 0::BIGINT AS alo, 0::BIGINT AS blo, i, j, n FROM runs
                       UNION ALL
                       SELECT pair, level + 1, side.alo, side.blo, side.i, side.j, side.n FROM (
                         SELECT pair, level, unnest([
                             {'alo': alo, 'blo': blo, 'i': i, 'j': j, 'n': least(n, -best.i - i, -best.j - j)},
                             {'alo': best.n - best.i, 'blo': best.n - best.j, 'i': i + skip, 'j': j + skip, 'n': n - skip}]) AS side
                         FROM (SELECT *, greatest(0, best.n - best.i - i, best.n - best.j - j) AS skip
                               FROM (SELECT *, max({'n': n, 'i': -i, 'j': -j}) OVER (PARTITION BY pair, alo, blo) AS best FROM cut_runs)))
                       WHERE side.n > 0""",
        "matched": "SELECT pair, max({'n': n, 'i': -i, 'j': -j}) AS best FROM cut_runs GROUP BY pair, level, alo, blo",
        "windows": """SELECT DISTINCT pair, s, l, begin_at, least(length(s), length(l) - begin_at) AS w FROM (
                        SELECT pair, greatest(0, best.i - best.j) AS begin_at FROM matched
                        UNION SELECT pair, length(l) - length(s) FROM likely) JOIN likely USING (pair)""",
        "in_window": """SELECT pair, begin_at, c, count(*) AS n FROM windows JOIN l_chars USING (l) WHERE j >= begin_at AND j < begin_at + w GROUP BY 1, 2, 3""",
        "window_bound": """SELECT pair, begin_at, sum(least(x.n, y.n)) AS most FROM in_window x JOIN likely USING (pair)
                           JOIN s_counts y ON y.s = likely.s AND y.c = x.c GROUP BY 1, 2""",
        "close": f"SELECT windows.* FROM windows JOIN window_bound USING (pair, begin_at) WHERE 200 * most >= {cut} * (length(s) + w)",
        "rising": """SELECT pair, begin_at, any_value(length(s) + w) AS total, len(list_reduce(list(i ORDER BY j, i DESC),
                     lambda t, x: list_concat(list_filter(t, lambda y: y < x), [x], list_filter(t, lambda y: y >= x)[2:]), []::BIGINT[])) AS common
                     FROM close JOIN places USING (pair) WHERE j >= begin_at AND j < begin_at + w GROUP BY 1, 2""",
        "partial": f"""SELECT a, b, max(floor(200 * common / total + 0.5))::INT AS ratio FROM rising JOIN sided USING (pair)
                       GROUP BY 1, 2 HAVING max(floor(200 * common / total + 0.5)) > {W.fuzzy_cutoff}""",
    }


def partial_ratio(text: str) -> str:
    return f"coalesce((SELECT p.ratio FROM partial p WHERE p.a = {words(text)} AND p.b = {words('q')}), 0)"


def snippet_ctes() -> dict[str, str]:
    """CTE ``snippets``: of each result, how many lines of its chunk match, the first long one of
    those, and the first long line that holds a word of the query."""
    line = sub_all("line", t.ANY_TAG)
    return {
        "chunk_lines": """SELECT qid, pid, lower(q) AS q, unnest(string_split(lower(chunk), chr(10))[2:]) AS line,
                          generate_subscripts(string_split(lower(chunk), chr(10))[2:], 1) AS pos FROM deduped""",
        "chunk_texts": f"SELECT * FROM (SELECT qid, pid, q, pos, {line} AS line FROM chunk_lines) WHERE length(line) >= {W.min_line_chars}",
    }


def snippet_choice() -> dict[str, str]:
    return {
        "judged": f"""SELECT qid, pid, pos, line, {partial_ratio('line')} > {W.fuzzy_cutoff} AS hit, length(line) > {W.snippet_chars} AS long,
                      len(list_filter(string_split(q, ' '), lambda w: contains(line, w))) > 0 AS word FROM chunk_texts""",
        "snippets": """SELECT qid, pid, count(*) FILTER (hit) AS line_hits, arg_min(line, pos) FILTER (hit AND long) AS matched_line,
                       arg_min(line, pos) FILTER (word AND long) AS word_line FROM judged GROUP BY 1, 2""",
    }


def rank_ctes(ratio=contains_ratio, snippets: bool = False) -> dict[str, str]:
    stored = "coalesce(summary, '')"
    bonus = lambda c, w: f"CASE WHEN {c} > {W.fuzzy_cutoff} THEN {w} * {c} / 100 ELSE 0 END"
    word_line, matched_line, hits = (f"coalesce({c}, {d})" for c, d in (("word_line", "''"), ("matched_line", "''"), ("line_hits", "0")))
    if not snippets:
        word_line, matched_line, hits = "''", "''", "0"
    chosen = f"""CASE WHEN length({word_line}) > 10 THEN {word_line} WHEN length({stored}) < {W.short_summary_chars} THEN {matched_line}
                 ELSE {stored} END"""
    score = f"""score + {bonus('url_ratio', W.url_match)} + {bonus('title_ratio', W.title_match)}
        + CASE WHEN {stored} <> '' AND contains(lower({stored}), lower(q)) THEN {W.summary_match} ELSE 0 END
        + {W.matching_line} * {hits}
        - CASE WHEN {has_tail('url')} THEN {W.query_or_fragment} ELSE 0 END
        - CASE WHEN length(lower(title)) > 50 THEN {W.long_title}::DOUBLE * length(lower(title)) / 50 ELSE 0 END
        - {W.repeat_url} - CASE WHEN {hits} = 0 THEN {W.no_matching_line} ELSE 0 END - CASE WHEN {chosen} = '' THEN {W.no_summary} ELSE 0 END"""
    pairs = " UNION ".join(f"SELECT {words(c)} AS a, {words('q')} AS b FROM deduped" for c in ("url", "title"))
    lines = {}
    if snippets:
        lines = snippet_ctes()
        pairs += f" UNION SELECT {words('line')}, {words('q')} FROM chunk_texts"
    if ratio is partial_ratio:
        lines |= partial_ctes(pairs)
    source = "deduped"
    if snippets:
        lines |= snippet_choice()
        source = "deduped LEFT JOIN snippets USING (qid, pid)"
    return search_ctes() | lines | {
        "ratios": f"SELECT *, {ratio('url')} AS url_ratio, {ratio('title')} AS title_ratio FROM {source}",
        "scored": f"""SELECT * REPLACE (round(({score})::DOUBLE, 6) + 0 AS score,
                      {sub_all(chosen, chr(92) + '[' + chr(92) + 'd+' + chr(92) + ']')} AS summary),
                      {host('url')} AS domain, {breadcrumb('url')} AS path FROM ratios""",
        "ranked": "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, base_rank) AS rank FROM scored",
        "sited": f"""SELECT *, {site('domain')} = first_value({site('domain')}) OVER (PARTITION BY qid ORDER BY rank) AS in_first
                     FROM ranked""",
        "placed": """SELECT *, rank = 1 AS first_result, row_number() OVER (PARTITION BY qid ORDER BY rank) AS position
                     FROM sited WHERE rank = 1 OR NOT in_first""",
    }


def links_ctes() -> dict[str, str]:
    base_path = path_of("url")
    origin = extract("url", u.ORIGIN_PATTERN)
    absolute = f"""CASE WHEN regexp_matches(href, '(?i)^https?://') THEN href
        WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN NULL
        WHEN starts_with(href, '//') THEN regexp_extract(url, '^([^:]+:)', 1) || href
        WHEN starts_with(href, '/') THEN {origin} || href
        WHEN href = '' OR starts_with(href, '#') THEN regexp_replace(url, '#.*$', '')
        WHEN starts_with(href, '?') THEN {origin} || {base_path} || href
        ELSE {origin} || regexp_replace({base_path}, '[^/]*$', '') || href END"""
    return {k: v for k, v in article_ctes().items() if k in ("entities", "cleaned")} | {
        "hrefs": f"SELECT page_id, url, unnest(regexp_extract_all(clean, {lit(HREF)}, 1)) AS quoted FROM cleaned",
        "links_raw": f"""SELECT page_id, url, trim({decode('bare')}) AS href FROM
                         (SELECT *, regexp_replace(quoted, '^["'']|["'']$', '', 'g') AS bare FROM hrefs), entities""",
        "absolute": f"SELECT *, {absolute} AS abs FROM links_raw",
        "links": f"""SELECT page_id, url, href, {normalized('abs')} AS link FROM absolute WHERE {extract('abs', u.ORIGIN_PATTERN)} <> ''
                     AND {host('abs')} = {host('url')}""",
    }


def reach_ctes() -> dict[str, str]:
    """CTE ``reached(url, depth)`` of the site whose pages also lead to two others of their host each."""
    ctes = links_ctes()
    linked = {
        "seats": f"SELECT *, {host('url')} AS host, row_number() OVER (PARTITION BY {host('url')} ORDER BY page_id) AS n FROM pages",
        "tree": """SELECT s.page_id, s.url, s.html || coalesce(string_agg('<a href="' || replace(t.url, '&', '&amp;') || '">more</a>', '' ORDER BY t.n), '') AS html
                   FROM seats s LEFT JOIN seats t ON t.host = s.host AND t.n IN (2 * s.n, 2 * s.n + 1) GROUP BY s.page_id, s.url, s.html""",
    }
    ctes["cleaned"] = ctes["cleaned"].replace("FROM pages", "FROM tree")
    return linked | ctes | {
        "edges": f"SELECT DISTINCT {normalized('url')} AS source, link FROM links WHERE NOT {denied('lower(link)')}",
        "reached": f"""SELECT {normalized('url')} AS url, 0 AS depth FROM seats WHERE n = 1
                       UNION SELECT link, depth + 1 FROM reached JOIN edges ON source = reached.url WHERE depth < 4""",
    }


def normalized(expr: str) -> str:
    """Paths of the test pages hold no dot parts, which only the Spark side resolves."""
    query = encode_unsafe(extract(expr, u.QUERY_PATTERN))
    return f"""lower({extract(expr, u.ORIGIN_PATTERN)}) || {path_of(expr)} || CASE WHEN {extract(expr, u.QUERY_PATTERN)} = '' THEN ''
        ELSE '?' || array_to_string(list_sort(string_split({query}, '&')), '&') END"""


def denied(expr: str) -> str:
    return "(" + " OR ".join(f"contains({expr}, {lit(d)})" for d in LINK_DENY_LIST) + ")"


def variants(expr: str) -> str:
    return f"""list_concat(list_filter(string_split({expr}, ' '), lambda w: w <> ''),
        flatten(list_transform(list_filter(string_split({expr}, ' '), lambda w: w <> ''), lambda w: list_filter(
        [upper(substr(w, 1, 1)) || substr(w, 2), upper(w), lower(w)], lambda v: v <> w))))"""


def distinct_in_order(expr: str) -> str:
    return f"""list_reduce({expr}, lambda a, x: CASE WHEN list_contains(a, x) THEN a ELSE list_append(a, x) END, []::VARCHAR[])"""


PLANES_INDEX = LshIndex(dims=64, tables=8, planes=4)  # as the query vector_topk_planes has it


def planes_topk(index, cosine: str) -> str:
    """The same planes as literals: vectors on one side of all planes of a table meet, and a query
    looks across its nearest planes too."""
    rows = ", ".join(f"({i // index.planes}, {i % index.planes}, [{', '.join(map(repr, column.tolist()))}])"
                     for i, column in enumerate(index.normals().T))
    return f"""WITH planes(t, p, normal) AS (VALUES {rows}),
        sides AS (SELECT vec_id, t, p, list_dot_product(embedding::DOUBLE[], normal) AS s FROM embeddings CROSS JOIN planes),
        codes AS (SELECT vec_id, t, sum(CASE WHEN s > 0 THEN 1 << p ELSE 0 END)::BIGINT AS code FROM sides GROUP BY 1, 2),
        near AS (SELECT vec_id, t, p FROM sides QUALIFY row_number() OVER (PARTITION BY vec_id, t ORDER BY abs(s), p) <= {index.probes}),
        looked AS (SELECT * FROM codes UNION ALL SELECT vec_id, t, xor(code, 1 << p) FROM codes JOIN near USING (vec_id, t)),
        pairs AS (SELECT DISTINCT l.vec_id AS qid, c.vec_id AS id FROM looked l JOIN codes c USING (t, code)),
        s AS (SELECT qid, id, round({cosine}, 12) + 0 AS score
              FROM pairs JOIN embeddings q ON q.vec_id = qid JOIN embeddings v ON v.vec_id = id)
        SELECT qid, id, round(score, 6) + 0 AS score, rank
        FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


def statements() -> dict[str, str]:
    doc_chunks = chunks_of("documents", "chr(10)", "doc_id")
    pages_parsed = parsed_ctes()
    ranked_columns = "qid, pid, url, title, score, summary, domain, path, url_ratio, title_ratio, base_rank, rank"
    known = "SELECT url, hash FROM stored WHERE starts_with(url, 'http://')"
    out: dict[str, str] = {}
    out["page_titles_hosts"] = with_ctes(article_ctes(), f"""SELECT page_id, title, host, {has_tail('url')} AS has_tail FROM articles""")
    out["article_text"] = with_ctes(article_ctes(), "SELECT page_id, coalesce(summary, '') AS summary, coalesce(sitename, '') AS sitename, text FROM articles")
    out["clean_paragraphs"] = with_ctes({"paras": doc_chunks["paras"]}, """SELECT doc_id, generate_subscripts(paragraphs, 1) AS pos,
        unnest(paragraphs) AS paragraph FROM paras""")
    out["merge_paragraphs"] = with_ctes({k: doc_chunks[k] for k in ("paras", "merging", "merged")}, """SELECT doc_id,
        generate_subscripts(merged, 1) AS pos, unnest(merged) AS paragraph FROM merged""")
    out["pack_chunks"] = with_ctes(doc_chunks, """SELECT doc_id, generate_subscripts(chunks, 1) AS pos, unnest(chunks) AS chunk
        FROM packed WHERE len(chunks) > 0""")
    out["chunk_rows"] = with_ctes(doc_chunks | {
        "kept": "SELECT doc_id, source || '/' || doc_id AS url, lang AS title, chunks FROM packed JOIN documents USING (doc_id) WHERE len(chunks) > 0",
        "numbered": "SELECT *, len(chunks) AS n, unnest(chunks) AS body, generate_subscripts(chunks, 1) AS i FROM kept",
    }, """SELECT sha256(url || '-' || i) AS id, url || '-' || i AS pid, url,
        title || ' part ' || i || ' of ' || n || ' (' || url || '):' || chr(10) || body AS chunk,
        sha256(array_to_string(chunks, chr(10))) AS hash FROM numbered""")
    out["dedup_url"] = f"""SELECT {site(host('url'))} || {path_of('url')} AS address, min(page_id) AS page_id FROM pages GROUP BY 1"""
    out["dedup_hash"] = "SELECT sha256(text) AS hash, min(doc_id) AS doc_id FROM documents GROUP BY 1"
    out["dedup_sequential"] = """WITH keys AS (SELECT doc_id AS page_id, source || '/' || string_split(text, ' ')[1] AS url,
            sha256(text) AS hash FROM documents),
        state AS (SELECT list_reduce(list({'o': page_id, 'u': url, 'h': hash} ORDER BY page_id),
            lambda s, r: CASE WHEN list_contains(s.us, r.u) OR list_contains(s.hs, r.h) THEN s
                ELSE {'us': list_append(s.us, r.u), 'hs': list_append(s.hs, r.h), 'os': list_append(s.os, r.o)} END,
            {'us': []::VARCHAR[], 'hs': []::VARCHAR[], 'os': []::BIGINT[]}).os AS os FROM keys)
        SELECT page_id, url, hash FROM keys WHERE page_id IN (SELECT unnest(os) FROM state)"""
    out["new_pages_only"] = with_ctes(store_ctes() | {"known": known,
        "fresh": "SELECT * FROM parsed WHERE url NOT IN (SELECT url FROM known) AND hash NOT IN (SELECT hash FROM known)"},
        "SELECT page_id, url, hash FROM fresh QUALIFY row_number() OVER (PARTITION BY hash ORDER BY page_id) = 1")
    out["url_exists"] = with_ctes(store_ctes(), """SELECT page_id, url, url IN (SELECT url FROM stored) AS known FROM pages""")
    out["stored_urls"] = with_ctes(store_ctes(), "SELECT url FROM stored")
    out["page_links"] = with_ctes(links_ctes(), "SELECT page_id, href, link FROM links")
    out["link_deny"] = with_ctes(links_ctes(), f"""SELECT page_id, link, {denied('lower(link)')} AS denied,
        {denied('link')} AS denied_case_sensitive FROM links""")
    out["frontier"] = with_ctes(links_ctes() | {
        "visited": f"SELECT {normalized('url')} AS url FROM pages",
        "targets": f"SELECT DISTINCT link AS url, 1 AS depth FROM links WHERE NOT {denied('lower(link)')}",
    }, "SELECT url, depth FROM targets WHERE url NOT IN (SELECT url FROM visited) ORDER BY depth, url LIMIT 100")
    out["frontier_all"] = out["frontier"].replace(" ORDER BY depth, url LIMIT 100", "")
    out["crawl_counts"] = with_ctes(links_ctes(), f"""SELECT (SELECT count(*) FROM pages) AS visited,
        (SELECT count(*) FROM links WHERE NOT {denied('lower(link)')}) AS enqueued""")
    out["site_key"] = f"SELECT page_id, {host('url')} AS host, {site(host('url'))} AS site FROM pages"
    out["breadcrumb"] = f"SELECT page_id, {breadcrumb('url')} AS path FROM pages"
    dot = "list_dot_product(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"
    norms = "sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) * sqrt(list_dot_product(v.embedding::DOUBLE[], v.embedding::DOUBLE[]))"
    dist = "sqrt(list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
    for name, expr, order in (("vector_topk", f"{dot} / ({norms})", "DESC"), ("vector_topk_dot", dot, "DESC"), ("vector_topk_euclidean", dist, "ASC")):
        out[name] = f"""WITH s AS (SELECT q.vec_id AS qid, v.vec_id AS id, round({expr}, 12) + 0 AS score
            FROM embeddings q CROSS JOIN embeddings v)
            SELECT qid, id, round(score, 6) + 0 AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score {order}, id) AS rank FROM s) WHERE rank <= 10"""
    # These three choose the exact search where approximate answers would save too little, as on the test table.
    out["vector_topk_lists"] = out["vector_topk_ivf"] = out["vector_topk_lsh"] = out["vector_topk"]
    out["vector_ivf_recall"] = """SELECT count(*) AS n_queries, count(*) * least(10, count(*)) AS n_true, true AS recall_reached FROM documents"""
    out["vector_topk_planes"] = planes_topk(PLANES_INDEX, f"{dot} / ({norms})")
    out["hashed_embedding"] = with_ctes(embed_ctes("documents", "doc_id", "text", "d"), "SELECT doc_id, dim, round(w, 6) AS weight FROM d_w")
    out["ingest_webpages"] = with_ctes(store_ctes(), "SELECT hash, title, url, summary, host AS sitename FROM stored")
    out["ingest_chunks"] = with_ctes(store_ctes(), "SELECT id, pid, url, chunk FROM chunk_rows")
    out["search_join"] = with_ctes(search_ctes(), "SELECT qid, q, pid, url, title, chunk, summary, score FROM results")
    out["result_dedup"] = with_ctes(search_ctes(), "SELECT qid, pid, url, score, base_rank FROM deduped")
    out["rank_rules"] = with_ctes(rank_ctes(), f"SELECT {ranked_columns} FROM ranked")
    out["rank_fuzzy"] = with_ctes(rank_ctes(levenshtein_ratio), f"SELECT {ranked_columns} FROM ranked")
    out["rank_partial_ratio"] = with_ctes(rank_ctes(partial_ratio), f"SELECT {ranked_columns} FROM ranked")
    out["rank_intended_snippets"] = with_ctes(rank_ctes(partial_ratio, True), f"SELECT {ranked_columns} FROM ranked")
    out["first_site_group"] = with_ctes(rank_ctes() | {
        "member_rows": "SELECT p.qid, p.position, true AS first_result, s.rank, s.url, s.score FROM placed p JOIN sited s USING (qid) WHERE p.first_result AND s.in_first",
    }, """SELECT qid, position, first_result, rank, url, score FROM member_rows
        UNION ALL SELECT qid, position, first_result, rank, url, score FROM placed WHERE NOT first_result""")
    out["site_links"] = with_ctes(rank_ctes() | {
        "members": "SELECT qid, url, title, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM sited WHERE in_first",
    }, "SELECT qid, n - 1 AS slot, url, title FROM members WHERE n BETWEEN 2 AND 4")
    out["result_pages"] = with_ctes(rank_ctes(), """SELECT qid, position, url, CAST(ceil(position / 30) AS INT) AS page,
        count(*) OVER (PARTITION BY qid) AS total, CAST(ceil(count(*) OVER (PARTITION BY qid) / 30) AS INT) AS total_pages FROM placed""")
    out["domain_results"] = with_ctes(rank_ctes() | {"one": f"SELECT * FROM sited WHERE {site('domain')} = 'example.com'"},
        """SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY rank) AS position, url,
        count(*) OVER (PARTITION BY qid) AS total FROM one""")
    marked = f"""list_reduce({distinct_in_order(variants('q'))}, lambda acc, v: replace(acc, v, '<b>' || v || '</b>'), summary)"""
    out["highlight"] = with_ctes(rank_ctes(), f"SELECT qid, position, url, {marked} AS summary FROM placed")
    out["store_stats"] = with_ctes(search_ctes(), f"""SELECT 'webpages' AS name, count(*) AS n_rows, 0 AS dims FROM stored
        UNION ALL SELECT 'chunks', count(*), 0 FROM chunk_rows UNION ALL SELECT 'vectors', count(*), {DIMS} FROM chunk_rows""")
    out["reset_check"] = with_ctes(store_ctes(), """SELECT ((SELECT count(*) FROM stored) + 2 * (SELECT count(*) FROM chunk_rows))::BIGINT AS n_before,
        0::BIGINT AS n_left, true AS is_empty""")
    out["stream_ingest_marked"] = out["stream_ingest"] = with_ctes(store_ctes(), "SELECT hash FROM stored")
    out["stream_frontier"] = out["frontier_all"].replace("SELECT url, depth FROM targets", "SELECT url FROM targets")
    out["upsert_vectors"] = """SELECT vec_id::VARCHAR AS id, dim, round(CASE WHEN label < 5 THEN 2 * x ELSE x END::DOUBLE, 6) AS value
        FROM (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings)"""
    out["delete_vectors"] = "SELECT vec_id::VARCHAR AS id FROM embeddings WHERE label >= 5"
    out["upsert_partitions"], out["delete_partitions"] = out["upsert_vectors"], out["delete_vectors"]
    out["orphan_chunks"] = with_ctes(store_ctes(), """SELECT id, url FROM chunk_rows
        WHERE url NOT IN (SELECT url FROM stored WHERE starts_with(url, 'https://'))""")
    out["sitemap_index"] = "SELECT 'map=' || page_id // 1000 AS sitemap, url FROM pages"
    out["model_embedding"] = out["hashed_embedding"]
    out["dense_text"] = with_ctes(dense_ctes(), """SELECT page_id, coalesce(text, '') AS text FROM numbered LEFT JOIN decoded USING (page_id)""")
    out["seed_urls"] = """SELECT 'text' AS source, url FROM pages UNION ALL SELECT 'sitemap', url FROM pages
        UNION ALL (SELECT 'single', url FROM pages ORDER BY page_id LIMIT 1)"""
    out["crawl_step"] = with_ctes(links_ctes() | {
        "first": "SELECT url FROM pages ORDER BY page_id LIMIT 1",
        "visited": f"SELECT {normalized('url')} AS url FROM (SELECT url FROM pages WHERE starts_with(url, 'http://') UNION ALL SELECT url FROM first)",
        "targets": f"SELECT DISTINCT link AS url FROM links WHERE starts_with(url, 'http://') AND NOT {denied('lower(link)')}",
    }, """SELECT 'many' AS seeds, url, 0 AS depth FROM pages WHERE NOT starts_with(url, 'http://')
        UNION ALL SELECT 'one', url, 0 FROM first WHERE NOT starts_with(url, 'http://')
        UNION ALL SELECT 'one', url, 1 FROM targets WHERE url NOT IN (SELECT url FROM visited)""")
    out["crawl_reach"] = with_ctes(reach_ctes(), "SELECT url, min(depth) AS depth FROM reached GROUP BY url")
    out["crawl_reach_capped"] = out["crawl_reach"] + " ORDER BY depth, url LIMIT 100"
    out["ingest_rejects"] = with_ctes(pages_parsed, """SELECT 'no address' AS reason, count(*) + count(*) FILTER (page_id % 2 = 0) AS n FROM pages
        UNION ALL SELECT 'no html', count(*) FROM pages
        UNION ALL SELECT 'no text', count(*) FILTER (page_id % 3 = 0) + count(*) - (SELECT count(*) FROM parsed) FROM pages""")
    out["ingest_observed"] = out["ingest_rejects"]
    out["served_page_contains"] = with_ctes(rank_ctes() | {
        "members": "SELECT qid, url, row_number() OVER (PARTITION BY qid ORDER BY rank) AS n FROM sited WHERE in_first",
        "further": "SELECT qid, string_agg(url, ' ' ORDER BY n) AS urls FROM members WHERE n BETWEEN 2 AND 4 GROUP BY qid",
        "sized": "SELECT *, count(*) OVER (PARTITION BY qid) AS total FROM placed",
    }, f"""SELECT qid, position, 1 AS page, CAST(ceil(total / 30) AS INT) AS total_pages, first_result, url, title, {marked} AS summary,
        path, CASE WHEN first_result THEN coalesce(urls, '') ELSE '' END AS site_links
        FROM sized LEFT JOIN further USING (qid) WHERE position <= 30""")
    out["served_page"] = with_ctes(rank_ctes(partial_ratio) | {"sized": "SELECT *, count(*) OVER (PARTITION BY qid) AS total FROM placed"},
        f"""SELECT qid, position, 1 AS page, CAST(ceil(total / 30) AS INT) AS total_pages, first_result, url, title, {marked} AS summary,
        path FROM sized WHERE position <= 30""")
    return out
