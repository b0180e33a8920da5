"""The same queries as SQL for DuckDB."""

from __future__ import annotations

from ..functions.text import COLORS
from ..operators import linker, reports
from ..operators.learning import FAULT_WEIGHT
from . import printed, suppliers
from .queries import HARD_BRANDS, HEADER_PATTERNS, LATE, LINE_PATTERNS, MANUAL_BRANDS, OWNERS, PROVIDER_PATTERNS, SEARCHES


def _value(x) -> str:
    return "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)



_LINES = """lines AS (SELECT l_orderkey AS invoice, l_linenumber AS line_no, l_partkey AS article_id, l_suppkey AS provider_id, l_quantity::INT AS stems, (5 * (1 + l_partkey % 5))::INT AS pack,
  floor(l_quantity / (5 * (1 + l_partkey % 5)))::INT AS bunches, l_extendedprice * (1 - l_discount) / l_quantity AS price_per_stem, l_extendedprice AS line_total, l_extendedprice::DECIMAL(18,2) AS amount,
  CASE l_returnflag WHEN 'N' THEN 'ok' WHEN 'A' THEN 'ambiguous_match' ELSE 'sin_match' END AS match_status, CASE WHEN l_linenumber % 2 = 0 THEN 'fuzzy 90%' ELSE 'exact' END AS match_method,
  l_discount * 10 AS link_confidence, 1 - l_tax * 2.5::DOUBLE AS match_confidence, l_linenumber / 50.0::DOUBLE AS candidate_margin,
  CASE WHEN l_linestatus = 'O' THEN 0.9::DOUBLE ELSE 0.45::DOUBLE + l_tax * 5 END AS extraction_confidence, CASE WHEN l_linenumber = 7 THEN 'rescue' ELSE 'native' END AS extraction_source FROM lineitem)"""
_HEADERS = "headers AS (SELECT o_orderkey AS invoice, o_totalprice::DECIMAL(18,2) AS header_total, o_orderdate AS dated FROM orders)"
_ARTICLES = """articles AS (SELECT p_partkey AS id, upper(p_name) AS variety, upper(p_brand) AS brand, p_size AS size, (5 * (1 + p_partkey % 5))::INT AS pack, p_type AS family,
  format('{} {}CM {}U{}', upper(p_name), p_size, 5 * (1 + p_partkey % 5), CASE WHEN p_partkey % 3 = 0 THEN '' ELSE ' ' || upper(p_brand) END) AS name,
  (CASE WHEN p_partkey % 4 = 0 THEN 'A' ELSE 'F' END) || lpad(p_partkey::VARCHAR, 6, '0') AS reference FROM part)"""
_REQUESTS = "requests AS (SELECT id AS line_id, variety, brand, (size + id % 3 - 1)::INT AS size, pack, family FROM articles)"
_LOG = """log AS (SELECT event_id, ts, user_id AS key, CASE event_type WHEN 'view' THEN 'proposal' WHEN 'purchase' THEN 'confirm' WHEN 'error' THEN 'correct' ELSE 'other' END AS kind, value AS confidence,
  json_extract_string(props, '$.k')::INT AS article_id FROM events)"""
_TEXT = """text_lines AS (SELECT doc_id, (u.i)::INT AS line_no, u.line FROM documents, LATERAL (SELECT unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i) u)"""
_BOXED = """boxed AS (SELECT l.*, CASE WHEN p_partkey % 3 = 0 THEN replace(upper(p_name), ' ', '/') ELSE upper(p_name) END AS variety, CASE WHEN p_partkey % 7 = 0 THEN 'MIX' ELSE 'HB' END AS box_type, upper(p_name) AS raw, p_size AS size
  FROM lines l JOIN part ON article_id = p_partkey)"""
_REL = "CASE WHEN stems * price_per_stem = 0 THEN abs(line_total) ELSE abs(line_total - stems * price_per_stem) / abs(stems * price_per_stem) END"
_CHECKED = f"""checked AS (SELECT *, [x FOR x IN [CASE WHEN stems > 0 AND bunches > 0 AND pack > 0 AND bunches * pack <> stems THEN 'stems_mismatch' END,
  CASE WHEN stems > 0 AND price_per_stem > 0 AND line_total > 0 AND {_REL} > 0.02 THEN 'total_mismatch' END, CASE WHEN match_status = 'ok' AND line_total <= 0 THEN 'line_total_zero' END] IF x IS NOT NULL] AS errors FROM lines)"""
_LANED = """laned AS (SELECT *, CASE WHEN match_status IN ('sin_match', 'sin_parser', 'llm_extraido') OR extraction_source = 'rescue' OR extraction_confidence < 0.5 OR (match_status = 'ambiguous_match' AND link_confidence < 0.5) THEN 'full'
  WHEN match_status = 'ok' AND len(errors) = 0 AND link_confidence >= 0.8 AND match_confidence >= 0.8 AND candidate_margin >= 0.05 AND extraction_confidence >= 0.8 THEN 'auto' ELSE 'quick' END AS lane FROM checked)"""
_BALANCE = """balance AS (SELECT s.invoice, s.s::DOUBLE AS sum_lines, header_total::DOUBLE AS header_total, CASE WHEN header_total > 0 THEN (s.s - header_total)::DOUBLE END AS header_diff,
  NOT (header_total > 0 AND abs(s.s - header_total)::DOUBLE > 0.01::DOUBLE * header_total::DOUBLE) AS header_ok FROM (SELECT invoice, sum(amount) AS s FROM lines GROUP BY invoice) s JOIN headers USING (invoice))"""


def _review(threshold: str, fuzzy: bool) -> str:
    return f"(match_status IN ('ambiguous_match', 'sin_match', 'sin_parser') OR len(errors) > 0 OR (match_status = 'ok' AND match_confidence < {threshold}::DOUBLE){' OR match_method LIKE ' + chr(39) + 'fuzzy%' + chr(39) if fuzzy else ''})"


_KPIS = f"""kpis AS (SELECT invoice, count(*) AS n_lines, count(*) FILTER (match_status = 'ok') AS n_ok, count(*) FILTER (match_status = 'ambiguous_match') AS n_ambiguous, count(*) FILTER (match_status = 'sin_match') AS n_unmatched,
  count(*) FILTER (extraction_source = 'rescue') AS n_rescued, count(*) FILTER ({_review('0.8', False)}) AS n_review, sum(amount)::DOUBLE AS total FROM checked GROUP BY invoice)"""
_MAP = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in COLORS.items()) + "}"


def _colors(x: str) -> str:
    return f"coalesce(element_at({_MAP}, {x})[1], array_to_string([coalesce(element_at({_MAP}, w)[1], w) FOR w IN regexp_split_to_array({x}, ' +')], ' '))"


_ROLL = """roll AS (SELECT provider_id, count(*) AS total_parsed, count(*) FILTER (extraction_source = 'rescue') AS total_rescued, count(*) FILTER (match_status = 'ok') AS ok_lines, count(*) FILTER (match_status = 'ambiguous_match') AS ambiguous_lines,
  count(*) FILTER (match_status = 'sin_match') AS sin_match_lines, count(*) FILTER (lane = 'auto') AS auto_lines, count(*) FILTER (len(errors) > 0) AS error_lines FROM laned GROUP BY ROLLUP (provider_id)),
rates AS (SELECT *, CASE WHEN ok_lines + ambiguous_lines = 0 THEN 0.0::DOUBLE ELSE round(auto_lines::DOUBLE / (ok_lines + ambiguous_lines), 3) END AS auto_rate FROM roll)"""
_CAND = """named AS (SELECT line_id, k.rank, k.name FROM requests, LATERAL (SELECT unnest([0, 1]) AS rank, unnest([format('{} {}CM {}U {}', variety, size, pack, brand), format('{} {}CM {}U', variety, size, pack)]) AS name) k),
exacts AS (SELECT line_id, arg_min(id, rank * 1000000000 + id) AS article_id, CASE WHEN min(rank) = 0 THEN 'branded' ELSE 'exact' END AS source FROM named JOIN articles USING (name) GROUP BY line_id),
rungs AS (SELECT r.line_id, r.line_id % 50 AS provider_id, a.id, a.id * 7 % 50 AS of_provider, a.brand = r.brand AND NOT regexp_matches(a.name, '[0-9]U$') AS is_own, regexp_matches(a.name, '[0-9]U$') AS is_generic, r.size > 0 AND a.size = r.size AS same, abs(a.size - r.size) AS gap
  FROM requests r JOIN articles a ON a.variety = r.variety),
stepped AS (SELECT line_id, {'rung': CASE WHEN is_own THEN CASE WHEN same THEN 1 ELSE 4 END WHEN is_generic THEN CASE WHEN same THEN 3 ELSE 6 END ELSE 7 END, 'gap': gap, 'id': id} AS x FROM rungs),
ladder AS (SELECT line_id, min(x) AS x FROM stepped GROUP BY line_id),
prefixed AS (SELECT r.line_id, a.id AS article_id FROM requests r JOIN articles a ON r.size = a.size AND r.pack = a.pack AND starts_with(a.name, r.variety)),
every AS (SELECT line_id, article_id, source FROM exacts UNION ALL SELECT line_id, x.id, 'priority' FROM ladder UNION ALL SELECT line_id, article_id, 'prefix' FROM prefixed),
candidates AS (SELECT line_id, article_id, arg_min(source, list_position(['exact', 'branded', 'priority', 'prefix'], source)) AS source, count(*) AS n_sources FROM every GROUP BY line_id, article_id)"""
_VETO = """vetoed AS (SELECT c.*, r.variety, r.brand, r.size, r.pack, r.family, a.name AS a_name, a.brand AS a_brand, a.size AS a_size, a.pack AS a_pack, a.family AS a_family,
  [x FOR x IN [CASE WHEN r.family <> a.family AND r.family <> 'OTHER' THEN 'species' END, CASE WHEN r.size > 0 AND a.size > 0 AND abs(r.size - a.size) > 20 THEN 'size' END, CASE WHEN NOT starts_with(a.reference, 'F') THEN 'reference' END] IF x IS NOT NULL] AS vetoes
  FROM candidates c JOIN requests r USING (line_id) JOIN articles a ON a.id = c.article_id)"""
_SCORE = """tokened AS (SELECT *, [w FOR w IN string_split(variety, ' ') IF length(w) >= 3] AS tokens, regexp_matches(a_name, '[0-9]U$') AS generic FROM vetoed WHERE len(vetoes) = 0),
parts AS (SELECT *, NOT generic AND brand = a_brand AS own_brand, len([w FOR w IN tokens IF contains(a_name, w)]) AS hits FROM tokened),
sums AS (SELECT *, CASE WHEN hits > 0 THEN 300 ELSE -100 END + CASE WHEN len(tokens) > 0 AND hits = len(tokens) THEN 100 ELSE 0 END + CASE WHEN size = a_size THEN 200 WHEN abs(size - a_size) <= 10 THEN 50 WHEN abs(size - a_size) <= 20 THEN -100 ELSE 0 END
  + CASE WHEN family = a_family THEN 150 ELSE 0 END + CASE WHEN pack = a_pack THEN 100 ELSE 0 END AS so_far, max(own_brand::INT) OVER (PARTITION BY line_id) AS peer FROM parts),
graded AS (SELECT *, greatest(so_far + CASE WHEN own_brand THEN 250 WHEN generic THEN CASE WHEN peer = 1 THEN -150 ELSE 0 END WHEN so_far >= 800 THEN -40 ELSE -250 END
  + CASE source WHEN 'branded' THEN 100 WHEN 'exact' THEN 80 ELSE 50 END, 0) / 1000.0::DOUBLE AS score FROM sums)"""
#: Each gold line in turn takes the best found line that is left.
_WALK = """pairs AS (SELECT g.doc_id, g.line_no AS gold_no, f.line_no AS found_no, CASE WHEN g.variety = f.variety THEN 10 WHEN contains(g.variety, f.variety) OR contains(f.variety, g.variety) THEN 5 ELSE 0 END
  + CASE WHEN g.size = f.size THEN 3 WHEN g.size <> 0 AND f.size <> 0 AND abs(g.size - f.size) <= 10 THEN 1 ELSE 0 END + CASE WHEN g.stems = f.stems THEN 2 ELSE 0 END AS points FROM gold g JOIN found f USING (doc_id)),
turns AS (SELECT doc_id, line_no AS gold_no, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS i FROM gold),
walk(doc_id, i, taken, gold_no, found_no, points) AS (SELECT DISTINCT doc_id, 0::BIGINT, []::INT[], NULL::INT, NULL::INT, NULL::INT FROM gold
  UNION ALL SELECT s.doc_id, s.i + 1, CASE WHEN s.best IS NULL THEN s.taken ELSE list_append(s.taken, -s.best.minus_no) END, s.gold, -s.best.minus_no, s.best.points FROM (SELECT w.doc_id, w.i, w.taken, t.gold_no AS gold,
    max({'points': p.points, 'minus_no': -p.found_no}) FILTER (p.points >= 5 AND NOT list_contains(w.taken, p.found_no)) AS best
    FROM walk w JOIN turns t ON t.doc_id = w.doc_id AND t.i = w.i + 1 LEFT JOIN pairs p ON p.doc_id = t.doc_id AND p.gold_no = t.gold_no GROUP BY w.doc_id, w.i, w.taken, t.gold_no) s),
walked AS (SELECT doc_id, gold_no, found_no, points FROM walk WHERE found_no IS NOT NULL)"""
_LINK = f"WITH {_ARTICLES}, {_REQUESTS}, {_CAND}"
_ASOF = """marks AS (SELECT *, last_value(CASE WHEN kind = 'proposal' THEN event_id END IGNORE NULLS) OVER w AS proposal_id, last_value(CASE WHEN kind = 'proposal' THEN confidence END IGNORE NULLS) OVER w AS proposed_confidence,
  last_value(CASE WHEN kind = 'proposal' THEN article_id END IGNORE NULLS) OVER w AS proposed_article FROM log WHERE kind <> 'other'
  WINDOW w AS (PARTITION BY key ORDER BY ts, CASE WHEN kind = 'proposal' THEN 0 ELSE 1 END, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
matched AS (SELECT event_id, key, kind, proposal_id, proposed_confidence, proposed_article FROM marks WHERE kind <> 'proposal')"""
_PRINTS = r"""marked AS (SELECT *, regexp_matches(trim(line), '[0-9]|\|') AND length(trim(line)) >= 10 AS is_data, len(regexp_split_to_array(trim(line), '[\t\n\x0B\f\r ]+')) AS n_f, length(line) - length(replace(line, '|', '')) AS pipe FROM text_lines),
shapes AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (is_data) AS n_data, coalesce(min(line_no) FILTER (is_data), 0)::BIGINT AS header_lines, (count(*) - 1 - coalesce(max(line_no) FILTER (is_data), count(*) - 1))::BIGINT AS footer_lines,
  coalesce(sum(pipe) FILTER (is_data), 0)::BIGINT AS pipes, coalesce(floor(median(n_f) FILTER (is_data)), 0)::BIGINT AS n_fields FROM marked GROUP BY doc_id),
typed AS (SELECT *, CASE WHEN pipes > n_data THEN 'pipe' WHEN n_data > 0 THEN 'spaces' ELSE '' END AS separator FROM shapes),
prints AS (SELECT doc_id, n_lines, n_data, header_lines, footer_lines, separator, n_fields, CASE WHEN separator <> '' AND n_fields >= 4 THEN 20 ELSE 0 END + CASE WHEN n_data >= 3 THEN 20 WHEN n_data >= 1 THEN 10 ELSE 0 END
  + CASE WHEN header_lines >= 3 AND footer_lines >= 1 THEN 10 ELSE 0 END AS points, substr(md5(concat_ws('|', separator, n_fields, CASE WHEN n_data >= 3 THEN 'true' ELSE 'false' END)), 1, 12) AS structure FROM typed)"""
_MINED = """tokens AS (SELECT provider_id, upper(string_split(p_name, ' ')[-1]) AS token FROM lines JOIN part ON article_id = p_partkey),
mined AS (SELECT *, row_number() OVER (PARTITION BY provider_id ORDER BY n DESC, token)::INT AS rank FROM (SELECT provider_id, token, count(*) AS n FROM tokens WHERE length(token) > 2 GROUP BY 1, 2 HAVING count(*) >= 5))"""
_FOLD = """counts AS (SELECT key, article_id, count(*) FILTER (kind = 'confirm') AS confirmed, count(*) FILTER (kind = 'correct') AS corrected, count(*) FILTER (kind = 'proposal') AS hits FROM log WHERE kind <> 'other' GROUP BY 1, 2),
states AS (SELECT *, CASE WHEN corrected >= 2 THEN 'rechazado' WHEN corrected = 1 THEN 'ambiguo' WHEN confirmed >= 1 OR hits >= 2 THEN 'aprendido_confirmado' ELSE 'aprendido_en_prueba' END AS status FROM counts)"""


_BASE = "CASE status WHEN 'manual_confirmado' THEN 0.98::DOUBLE WHEN 'aprendido_confirmado' THEN 0.85::DOUBLE WHEN 'aprendido_en_prueba' THEN 0.55::DOUBLE WHEN 'ambiguo' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END"
_TRUSTED = "round(CASE WHEN corrected > 0 THEN greatest(0.1::DOUBLE, b - 0.15::DOUBLE * corrected) WHEN confirmed > 1 THEN least(0.98::DOUBLE, b + 0.05::DOUBLE * least(confirmed - 1, 5)) ELSE b END, 3)"


def _first(p: str) -> str:
    return f"nullif(regexp_extract(trim(line), '{p}', 1), '')"


_BELOW, _ABOVE = _first(r"^(\S+)"), _first(r"(\S+)$")

# --- the whole linker


def _canon(x: str) -> str:
    return f"trim(regexp_replace(regexp_replace(upper({x}), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g'))"


def _expected(v: str) -> str:
    return f"""CASE species WHEN 'ROSES' THEN 'ROSA ' || CASE WHEN origin = 'EC' THEN 'EC ' ELSE 'COL ' END || upper({v}) || CASE WHEN size > 0 AND pack > 0 THEN format(' {{}}CM {{}}U', size, pack) ELSE '' END
  WHEN 'CARNATIONS' THEN concat_ws(' ', CASE WHEN pack = 10 THEN 'MINI CLAVEL COL' ELSE 'CLAVEL COL' END, 'FANCY', {_colors(f"upper({v})")}, format('{{}}CM {{}}U', CASE WHEN size > 0 THEN size ELSE 70 END, pack))
  WHEN 'HYDRANGEAS' THEN 'HYDRANGEA ' || upper({v}) || CASE WHEN size > 0 AND pack > 0 THEN format(' {{}}CM {{}}U', size, pack) ELSE '' END ELSE upper({v}) END"""


_RANK = "(CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in linker.PRIORITY.items()) + " END)"
_TOKEN = "[w FOR w IN string_split(v, ' ') IF length(w) >= 3 AND NOT list_contains([" + ", ".join(f"'{w}'" for w in linker.GENERIC) + "], w)]"
_PLAIN = lambda x: f"regexp_replace({x}, '{linker.CONNECTORS}', ' ', 'g')"
_BEHIND = f"regexp_replace(v, '{linker.COLORS_AFTER}', '')"
_CAT = f"""c0 AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 10 < 6 THEN 'ROSES' WHEN p_partkey % 10 < 8 THEN 'CARNATIONS' WHEN p_partkey % 10 = 8 THEN 'HYDRANGEAS' ELSE 'OTHER' END AS species, (10 * (p_size % 6 + 3))::INT AS size,
  CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 25 END::INT AS pack, CASE WHEN p_partkey % 40 = 0 THEN 'SPRAY MIXTO' WHEN p_partkey % 25 = 1 THEN upper(p_name) || ' BICOLOR' ELSE upper(p_name) END AS variety,
  CASE WHEN p_partkey % 4 = 0 THEN '' ELSE upper(p_brand) END AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'EC' ELSE 'COL' END AS o, p_partkey * 7 % 50 AS provider_id FROM part),
c1 AS (SELECT *, CASE species WHEN 'ROSES' THEN o WHEN 'CARNATIONS' THEN 'COL' ELSE '' END AS origin FROM c0), cat AS (SELECT *, {_expected("variety")} || CASE WHEN brand = '' THEN '' ELSE ' ' || brand END AS name, {_canon("variety")} AS av FROM c1),
l0 AS (SELECT id AS line_id, CASE WHEN id % 97 = 0 THEN 4471 ELSE id % 50 END::BIGINT AS provider_id, CASE WHEN id % 31 = 0 THEN 'OTHER' ELSE species END AS species,
  CASE WHEN id % 17 = 0 THEN CASE origin WHEN 'EC' THEN 'COL' WHEN 'COL' THEN 'EC' ELSE '' END ELSE origin END AS origin, CASE WHEN id % 12 = 0 THEN 'Red ' || variety WHEN id % 12 = 1 THEN variety || ' White' WHEN id % 12 = 2 THEN replace(variety, ' ', ' and ')
  WHEN id % 12 = 3 OR id % 97 = 0 THEN 'Farm ' || variety WHEN id % 12 = 4 THEN left(variety, length(variety) - 1) ELSE variety END AS variety, (size + CASE id % 5 WHEN 2 THEN 10 WHEN 3 THEN -10 WHEN 4 THEN 30 ELSE 0 END)::INT AS size,
  CASE WHEN id % 7 = 0 THEN 25 ELSE pack END::INT AS pack, species = 'ROSES' AND id % 19 = 0 AS spray FROM cat),
ll AS (SELECT *, {_canon("variety")} AS v FROM l0),
store AS (SELECT provider_id, species, v, size, pack, line_id + CASE WHEN line_id % 12 = 8 THEN 1 ELSE 0 END AS article_id, CASE (line_id // 6) % 4 WHEN 0 THEN 'manual_confirmado' WHEN 1 THEN 'aprendido_confirmado' WHEN 2 THEN 'aprendido_en_prueba' ELSE 'rechazado' END AS status
  FROM ll WHERE line_id % 6 = 2 QUALIFY row_number() OVER (PARTITION BY provider_id, species, v, size, pack ORDER BY line_id) = 1),
own AS (SELECT i AS provider_id, 'BRAND#' || (i % 25 + 1) AS brand FROM range(50) r(i) UNION ALL SELECT i, 'BRAND#' || ((i + 7) % 25 + 1) FROM range(50) r(i) WHERE i % 3 = 0), owns AS (SELECT provider_id, list(brand) AS brands FROM own GROUP BY 1),
used AS (SELECT p_partkey % 50 AS provider_id, p_partkey AS article_id, p_partkey % 5 AS used FROM part WHERE p_partkey % 3 = 0)"""
_STRIPS = f"""strips AS (SELECT DISTINCT line_id, provider_id, size, source, ord, form AS variety FROM (
  SELECT line_id, provider_id, size, v, 'priority' AS source, 0 AS ord, v AS form, true AS cond FROM ll
  UNION ALL SELECT line_id, provider_id, size, v, 'delegation', n, array_to_string(string_split(v, ' ')[n + 1:], ' '), provider_id = {linker.DELEGATING_PROVIDER} AND len(string_split(v, ' ')) > n FROM ll, (VALUES (1), (2), (3)) k(n)
  UNION ALL SELECT line_id, provider_id, size, v, 'color_prefix', 1, regexp_replace(v, '{linker.COLORS_BEFORE}', ''), species = 'ROSES' FROM ll UNION ALL SELECT line_id, provider_id, size, v, 'color_suffix', 1, {_BEHIND}, species = 'ROSES' FROM ll
  UNION ALL SELECT line_id, provider_id, size, v, 'connector_strip', 1, {_PLAIN("v")}, species = 'ROSES' FROM ll UNION ALL SELECT line_id, provider_id, size, v, 'connector_strip', 2, {_PLAIN(_BEHIND)}, species = 'ROSES' AND {_PLAIN(_BEHIND)} <> {_BEHIND} FROM ll
  UNION ALL SELECT line_id, provider_id, size, v, 'bicolor_ext', k.i, [v, {_BEHIND}, {_PLAIN("v")}, {_PLAIN(_BEHIND)}][k.i + 1] || ' BICOLOR', species = 'ROSES' FROM ll, (VALUES (0), (1), (2), (3)) k(i)) x
  WHERE cond AND form <> '' AND (source = 'priority' OR form <> v))"""
_LONGEST = "list_max([{'n': len([k FOR k IN range(1, least(ah - i, bh - bl) + 1) IF contains(substr(n, bl + 1, bh - bl), substr(q, i + 1, k))]), 'i': -i} FOR i IN range(al, ah)])"
#: From alike_in (pool, q, n) the five best names of each q by matching blocks: alike (pool, q, n, matched, ratio, place).
_ALIKE = f"""met_in AS (SELECT * FROM alike_in WHERE length(q) > 0 AND length(n) > 0 AND 2 * least(length(q), length(n)) >= 0.4::DOUBLE * (length(q) + length(n))),
ranges AS (SELECT pool, q, n, al, ah, bl, bh, {_LONGEST} AS best FROM (SELECT *, 0 AS al, length(q) AS ah, 0 AS bl, length(n) AS bh FROM met_in) z
  UNION ALL SELECT pool, q, n, al, ah, bl, bh, {_LONGEST} FROM (
    SELECT pool, q, n, x.al, x.ah, x.bl, x.bh FROM (SELECT *, -best.i AS i, bl + instr(substr(n, bl + 1, bh - bl), substr(q, 1 - best.i, best.n)) - 1 AS j FROM ranges WHERE best.n > 0) y,
      LATERAL (SELECT unnest([{{'al': al, 'ah': i, 'bl': bl, 'bh': j}}, {{'al': i + best.n, 'ah': ah, 'bl': j + best.n, 'bh': bh}}]) AS x) u WHERE x.al < x.ah AND x.bl < x.bh) w),
matched AS (SELECT pool, q, n, sum(best.n)::BIGINT AS matched FROM ranges GROUP BY ALL),
alike AS (SELECT *, 2.0::DOUBLE * matched / (length(q) + length(n)) AS ratio, row_number() OVER (PARTITION BY pool, q ORDER BY 2.0::DOUBLE * matched / (length(q) + length(n)) DESC, n)::INT AS place
  FROM matched WHERE 2.0::DOUBLE * matched / (length(q) + length(n)) >= 0.4::DOUBLE QUALIFY place <= 5)"""
_GATHER = f"""{_STRIPS},
met AS (SELECT s.line_id, s.source, s.ord, s.provider_id, s.size > 0 AND c.size = s.size AS same, abs(c.size - s.size) AS gap, c.id, c.provider_id AS of_provider, c.brand, coalesce(list_contains(o.brands, c.brand), false) AS is_own
  FROM strips s JOIN cat c ON c.av = s.variety LEFT JOIN owns o ON o.provider_id = s.provider_id),
ranked AS (SELECT line_id, source, ord, min(x).id AS article_id FROM (
  SELECT line_id, source, ord, {{'rung': CASE WHEN is_own THEN CASE WHEN same THEN 1 ELSE 4 END WHEN brand = '' THEN CASE WHEN same THEN 3 ELSE 6 END ELSE 7 END, 'gap': gap, 'id': id}} AS x FROM met
  UNION ALL SELECT line_id, source, ord, {{'rung': CASE WHEN same THEN 2 ELSE 5 END, 'gap': 0, 'id': id}} FROM met WHERE of_provider = provider_id) GROUP BY 1, 2, 3),
by_strip AS (SELECT line_id, article_id, source FROM ranked QUALIFY source <> 'delegation' OR row_number() OVER (PARTITION BY line_id, source ORDER BY ord) = 1),
asked AS (SELECT line_id, provider_id, {_expected("variety")} AS name FROM ll), by_name AS (SELECT name, min(id) AS article_id FROM cat GROUP BY 1),
exacts AS (SELECT line_id, arg_min(article_id, n) AS article_id FROM (SELECT line_id, 0 AS n, name FROM asked UNION ALL SELECT line_id, 1, regexp_replace(name, '^(ROSA|ALSTROMERIA) (?:EC|COL) ', '\1 ') FROM asked) a JOIN by_name USING (name) GROUP BY 1),
brandeds AS (SELECT line_id, b.article_id FROM asked a JOIN own o USING (provider_id) JOIN by_name b ON b.name = a.name || ' ' || o.brand),
begins AS (SELECT l.line_id, min(c.id) AS article_id FROM ll l JOIN cat c ON c.species = 'ROSES' AND l.species = 'ROSES' AND l.size > 0 AND l.pack > 0 AND c.size = l.size AND c.pack = l.pack AND c.origin = l.origin AND starts_with(c.av, l.v) AND string_split(c.av, ' ')[1] = string_split(l.v, ' ')[1] GROUP BY 1),
holds AS (SELECT l.line_id, min(c.id) AS article_id FROM ll l JOIN cat c ON c.species = 'ROSES' AND l.species = 'ROSES' AND l.size > 0 AND l.pack > 0 AND c.size = l.size AND c.pack = l.pack AND c.origin = l.origin AND contains(c.av, l.v) AND list_contains(string_split(c.av, ' '), string_split(l.v, ' ')[1])
  WHERE l.line_id NOT IN (SELECT line_id FROM begins) GROUP BY 1),
spelt AS (SELECT species, av, min(id) AS article_id FROM cat GROUP BY 1, 2),
alike_in AS (SELECT DISTINCT l.species AS pool, l.v AS q, s.av AS n FROM ll l JOIN spelt s ON s.species = l.species), {_ALIKE},
hits AS (SELECT l.line_id, s.article_id, (200 * matched // (length(l.v) + length(s.av)))::INT AS percent FROM ll l JOIN alike a ON a.pool = l.species AND a.q = l.v JOIN spelt s ON s.species = a.pool AND s.av = a.n),
every AS (SELECT line_id, article_id, 'synonym' AS source, NULL::INT AS percent, status FROM ll JOIN store USING (provider_id, species, v, size, pack) WHERE status <> 'rechazado'
  UNION ALL SELECT line_id, article_id, source, NULL, NULL FROM by_strip UNION ALL SELECT line_id, article_id, 'exact', NULL, NULL FROM exacts UNION ALL SELECT line_id, article_id, 'branded', NULL, NULL FROM brandeds
  UNION ALL SELECT line_id, article_id, 'rose', NULL, NULL FROM begins UNION ALL SELECT line_id, article_id, 'rose', NULL, NULL FROM holds UNION ALL SELECT line_id, article_id, 'fuzzy', percent, NULL FROM hits),
cands AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY line_id, article_id ORDER BY {_RANK}, source, percent DESC) = 1)"""
_VETOED = """beside AS (SELECT k.*, l.provider_id, l.species, l.origin, l.v, l.size, l.pack, l.spray, c.name AS a_name, c.species AS a_species, c.origin AS a_origin, c.size AS a_size, c.pack AS a_pack, c.brand AS a_brand,
  [x FOR x IN [CASE WHEN l.species <> c.species AND l.species <> 'OTHER' AND c.species <> 'OTHER' THEN 'species' END, CASE WHEN l.species IN ('ROSES', 'CARNATIONS') AND l.origin <> '' AND c.origin <> '' AND l.origin <> c.origin THEN 'origin' END,
  CASE WHEN l.size > 0 AND c.size > 0 AND abs(l.size - c.size) > 20 THEN 'size' END, CASE WHEN l.spray AND c.pack <> 10 THEN 'spray pack' END] IF x IS NOT NULL] AS vetoes FROM cands k JOIN ll l USING (line_id) JOIN cat c ON c.id = k.article_id)"""
_GRADED = f"""e0 AS (SELECT b.*, u.used, {_TOKEN} AS tokens, coalesce(list_contains(o.brands, b.a_brand), false) AS own_brand, source = 'synonym' AND status = 'manual_confirmado' AS is_manual,
  CASE WHEN source = 'synonym' THEN CASE status WHEN 'manual_confirmado' THEN 98 WHEN 'aprendido_confirmado' THEN 85 ELSE 55 END ELSE 0 END AS trust100 FROM beside b LEFT JOIN owns o ON o.provider_id = b.provider_id LEFT JOIN used u ON u.provider_id = b.provider_id AND u.article_id = b.article_id
  WHERE len(vetoes) = 0 OR coalesce(source = 'synonym' AND status = 'manual_confirmado', false)),
e1 AS (SELECT *, len([w FOR w IN tokens IF contains(a_name, w)]) > 0 AS any_token, len(tokens) > 0 AND len([w FOR w IN tokens IF contains(a_name, w)]) = len(tokens) AS every_token,
  len([w FOR w IN string_split(a_name, ' ') IF list_contains([{", ".join(f"'{w}'" for w in linker.COLOR_MODIFIERS)}], w) AND NOT list_contains(string_split(v, ' '), w)]) > 0 AS extra_color,
  size > 0 AND size = a_size AS size_exact, size > 0 AND abs(size - a_size) BETWEEN 1 AND 10 AS size_close, pack > 0 AND pack = a_pack AS pack_same FROM e0),
e2 AS (SELECT *, CASE WHEN any_token THEN 3000 WHEN trust100 >= 85 OR (source = 'fuzzy' AND percent >= 82) THEN 0 ELSE -1000 END + CASE WHEN every_token THEN 1000 ELSE 0 END - CASE WHEN extra_color THEN 1200 ELSE 0 END
  + CASE WHEN size_exact THEN 2000 WHEN size_close THEN 500 WHEN size > 0 AND abs(size - a_size) <= 20 THEN -1000 ELSE 0 END + CASE WHEN species = a_species THEN 1500 ELSE 0 END
  + CASE WHEN species IN ('ROSES', 'CARNATIONS') AND origin = a_origin AND origin <> '' THEN 1500 ELSE 0 END + CASE WHEN pack_same THEN 1000 ELSE 0 END AS so_far, max(own_brand::INT) OVER (PARTITION BY line_id) = 1 AS peer FROM e1),
e3 AS (SELECT *, greatest(so_far + CASE WHEN own_brand THEN 2500 WHEN a_brand IN ({", ".join(f"'{b}'" for b in HARD_BRANDS)}) THEN -2500 WHEN a_brand <> '' AND so_far >= 8000 THEN -400 WHEN peer THEN -1500 ELSE 0 END
  + CASE WHEN used >= 3 THEN 1000 WHEN used >= 1 THEN 500 ELSE 0 END + trust100 * 25 + CASE source WHEN 'synonym' THEN 1000 WHEN 'branded' THEN 1000 WHEN 'exact' THEN 800 WHEN 'rose' THEN 800 WHEN 'color_prefix' THEN 400 WHEN 'fuzzy' THEN 15 * coalesce(percent, 0) ELSE 500 END, 0)::INT AS points FROM e2),
graded AS (SELECT *, ((points + 5) // 10)::INT AS score FROM e3),
p0 AS (SELECT *, max(is_manual::INT) OVER (PARTITION BY line_id) = 1 AS manual, coalesce(own_brand AND any_token AND size_exact, false) AS can FROM graded),
p1 AS (SELECT *, row_number() OVER w AS pos, lead(can) OVER w AS r_can, lead(pack_same) OVER w AS r_pack, lead(every_token) OVER w AS r_every, lead(score) OVER w AS r_score, row_number() OVER t AS place, max(score) OVER (PARTITION BY line_id) AS top
  FROM p0 WINDOW w AS (PARTITION BY line_id ORDER BY can DESC, pack_same DESC, every_token DESC, score DESC, article_id), t AS (PARTITION BY line_id ORDER BY score DESC, article_id)),
p2 AS (SELECT *, coalesce(CASE WHEN place = 1 THEN max(CASE WHEN place = 2 THEN score END) OVER (PARTITION BY line_id) ELSE top END, 0) AS others FROM p1),
raised AS (SELECT * EXCLUDE (score), CASE WHEN is_manual IS TRUE THEN greatest(score, 1100, others + 50) WHEN can AND pos = 1 AND NOT manual AND (NOT coalesce(r_can, false) OR (pack_same AND NOT r_pack) OR (every_token AND NOT r_every) OR score > r_score + 50)
  THEN greatest(score, 1050, others + 50) ELSE score END::INT AS score FROM p2)"""
_DECIDED = f"""d0 AS (SELECT *, CASE WHEN NOT spray THEN 0 WHEN coalesce(source = 'synonym' AND status IN ('manual_confirmado', 'aprendido_confirmado'), false) THEN 0 WHEN every_token THEN 1 ELSE 2 END AS grp FROM raised),
d1 AS (SELECT *, row_number() OVER (PARTITION BY line_id ORDER BY grp, score DESC, {_RANK}, article_id) AS nr FROM d0),
d2 AS (SELECT l.line_id, l.spray, m.mixto_id, a.article_id AS a_id, a.source AS a_source, a.score AS a_score, a.grp AS a_grp, a.size_exact AS a_exact, a.size_close AS a_close, a.every_token AS a_every, a.any_token AS a_any, a.extra_color AS a_extra, a.percent AS a_percent,
  b.article_id AS b_id, b.source AS b_source, coalesce(b.score, 0) AS b_score, b.score AS b_own, b.size_exact AS b_exact, b.size_close AS b_close, b.every_token AS b_every, b.extra_color AS b_extra
  FROM ll l LEFT JOIN d1 a ON a.line_id = l.line_id AND a.nr = 1 LEFT JOIN d1 b ON b.line_id = l.line_id AND b.nr = 2 LEFT JOIN (SELECT size, min(id) AS mixto_id FROM cat WHERE variety = 'SPRAY MIXTO' AND pack = 10 GROUP BY 1) m ON m.size = l.size),
d3 AS (SELECT *, coalesce(a_score >= 700 AND b_score >= 700 AND a_score - b_score < CASE WHEN a_score >= 1050 THEN 20 WHEN a_score >= 900 THEN 50 ELSE 100 END, false) AS near, spray AND a_id IS NOT NULL AND a_grp = 2 AND mixto_id IS NOT NULL AS stand_in FROM d2),
d4 AS (SELECT *, near AND coalesce((b_exact AND NOT a_exact AND a_close) OR (b_every AND NOT a_every), false) AS swap FROM d3),
d5 AS (SELECT *, CASE WHEN NOT near THEN '' WHEN swap AND b_exact AND NOT a_exact AND a_close THEN 'size' WHEN swap THEN 'variety' WHEN a_exact AND NOT b_exact AND b_close THEN 'size' WHEN a_every AND NOT b_every THEN 'variety' WHEN b_extra AND NOT a_extra THEN 'color' ELSE '' END AS why0 FROM d4),
d6 AS (SELECT *, CASE WHEN a_id IS NULL THEN 'sin_match' WHEN stand_in THEN 'ambiguous_match' WHEN a_score >= 700 THEN CASE WHEN near AND why0 = '' THEN 'ambiguous_match' ELSE 'ok' END
  WHEN a_score >= 500 AND (a_any OR coalesce(a_percent >= 85, false) OR a_source = 'synonym') THEN 'ambiguous_match' ELSE 'sin_match' END AS status FROM d5)"""
_LINKER = f"WITH RECURSIVE {_CAT}, {_GATHER}"


_PAIRS = "[" + ", ".join(f"[{_value(a)}, {_value(b)}]" for a, b in sorted(reports.TRANSLATIONS.items(), key=lambda x: -len(x[0]))) + "]"
_WORDS = "MAP {" + ", ".join(f"{_value(a)}: {_value(b)}" for a, b in reports.TRANSLATIONS.items()) + "}"
#: From v (id, v) the forms of a variety in order: forms (id, i, form).
_FORMS = f"""bases AS (SELECT id, CASE WHEN b = v THEN [v] ELSE [v, b] END AS bases FROM (SELECT id, v, CASE {" ".join(f"WHEN starts_with(v, '{p}') THEN substr(v, {len(p) + 1})" for p in reports.PREFIXES)} ELSE v END AS b FROM v) x),
spelled AS (SELECT id, [f FOR f IN list_concat(bases, flatten([[replace(b, p[1], p[2]) FOR p IN {_PAIRS} IF contains(b, p[1])] FOR b IN bases]),
  [array_to_string([coalesce(element_at({_WORDS}, w)[1], w) FOR w IN string_split(b, ' ')], ' ') FOR b IN bases]) IF f <> ''] AS said FROM bases),
first_i AS (SELECT id, form, min(i) AS i FROM (SELECT id, unnest(said) AS form, unnest(range(len(said))) AS i FROM spelled) x GROUP BY 1, 2),
more AS (SELECT id, form, 1000 + 2 * i AS i FROM (SELECT id, i, substr(form, {len(reports.ADDED_PREFIX) + 1}) AS form FROM first_i WHERE starts_with(form, '{reports.ADDED_PREFIX}')) x
  UNION ALL SELECT id, '{reports.ADDED_PREFIX}' || form, 1001 + 2 * i FROM first_i),
forms AS (SELECT id, form, min(i) AS i FROM (SELECT * FROM first_i UNION ALL SELECT * FROM more) x GROUP BY 1, 2)"""

ORACLE_SQL: dict[str, str] = {
    "invoice_balance": f"WITH {_LINES}, {_HEADERS}, {_BALANCE} SELECT * FROM balance",
    "header_repair": f"""WITH {_LINES}, {_HEADERS}, j AS (SELECT h.invoice, header_total AS h, coalesce(s, 0) AS s FROM headers h LEFT JOIN (SELECT invoice, sum(amount) AS s FROM lines GROUP BY 1) x USING (invoice))
SELECT invoice, CASE WHEN h = 0 OR (s > 0 AND (h > s * 10 OR h * 10 < s)) THEN s ELSE h END::DOUBLE AS total, h = 0 OR (s > 0 AND (h > s * 10 OR h * 10 < s)) AS repaired FROM j""",
    "line_checks": f"WITH {_LINES}, {_CHECKED} SELECT invoice, line_no, article_id, provider_id, unnest(errors) AS code FROM checked",
    "review_lanes": f"WITH {_LINES}, {_CHECKED}, {_LANED} SELECT invoice, line_no, article_id, provider_id, len(errors)::INT AS n_errors, lane FROM laned",
    "invoice_kpis": f"WITH {_LINES}, {_CHECKED}, {_KPIS} SELECT * FROM kpis",
    "batch_summary": f"""WITH {_LINES}, {_HEADERS}, {_CHECKED}, {_KPIS}, {_BALANCE} SELECT count(*) AS invoices, sum(n_lines)::BIGINT AS lines, sum(n_ok)::BIGINT AS ok, sum(n_ambiguous)::BIGINT AS ambiguous, sum(n_unmatched)::BIGINT AS unmatched,
sum(n_rescued)::BIGINT AS rescued, sum(n_review)::BIGINT AS review, count(*) FILTER (NOT header_ok) AS unbalanced, count(*) FILTER (n_review = 0) AS clean_invoices FROM kpis JOIN balance USING (invoice)""",
    "needs_review_variants": f"WITH {_LINES}, {_CHECKED} SELECT match_status, count(*) AS n_lines, count(*) FILTER ({_review('0.8', False)}) AS review_strict, count(*) FILTER ({_review('0.84', True)}) AS review_wide FROM checked GROUP BY 1",
    "split_mixed": f"""WITH {_LINES}, {_BOXED}, cut AS (SELECT *, len(string_split(variety, '/')) = 2 AND box_type <> 'MIX' AS halved FROM boxed),
rows AS (SELECT *, unnest(CASE WHEN halved THEN string_split(variety, '/') ELSE [variety] END) AS one, unnest(CASE WHEN halved THEN [0, 1] ELSE [0] END) AS part FROM cut)
SELECT invoice, line_no, article_id, provider_id, part, trim(one) AS variety, CASE WHEN halved THEN floor(stems / 2)::INT ELSE stems END AS stems, CASE WHEN halved THEN floor(bunches / 2)::INT ELSE bunches END AS bunches,
CASE WHEN halved THEN round(amount::DECIMAL(18,4) * 0.5::DECIMAL(2,1), 2)::DOUBLE ELSE amount::DOUBLE END AS line_total, CASE WHEN halved THEN 'MIX' ELSE box_type END AS box_type FROM rows""",
    "group_mixed_boxes": f"""WITH {_LINES}, {_BOXED}, keyed AS (SELECT *, CASE WHEN box_type = 'MIX' THEN 'box ' || raw ELSE 'line ' || concat_ws(':', line_no, article_id, provider_id, stems, line_total) END AS group_key FROM boxed)
SELECT invoice, min(group_key) AS group_key, min(line_no) AS position, count(*) AS n_lines, sum(stems)::BIGINT AS stems, sum(amount)::DOUBLE AS line_total,
CASE WHEN count(*) > 1 THEN string_agg(article_id::VARCHAR, ',' ORDER BY line_no, article_id, provider_id, stems) END AS children FROM keyed GROUP BY invoice, keyed.group_key""",
    "reclassify_assorted": f"""WITH {_LINES}, {_BOXED}, r AS (SELECT amount, CASE WHEN match_status IN ('sin_match', 'ambiguous_match') AND regexp_matches(trim(variety), '(?i)^(MIX|MIXED|ASSORTED|SMALL .*|HOT.RING)$') THEN 'mixed_box' ELSE match_status END AS match_status FROM boxed)
SELECT match_status, count(*) AS n_lines, sum(amount)::DOUBLE AS total FROM r GROUP BY 1""",
    "rescue_lines": rf"""WITH {_TEXT}, parsed AS (SELECT doc_id, trim(line) AS raw, upper(trim(string_split(line, ' ')[1])) AS variety FROM text_lines WHERE line_no = 0)
SELECT t.doc_id, t.line_no, trim(t.line) AS raw FROM text_lines t LEFT JOIN parsed p USING (doc_id) WHERE length(trim(t.line)) >= 10 AND regexp_matches(trim(t.line), '(?i)\b(the|de|der|la)\b')
AND NOT regexp_matches(trim(t.line), '(?i)\b(licensed|version|token)\b') AND regexp_matches(t.line, '[0-9]') AND NOT (p.raw <> '' AND contains(trim(t.line), p.raw)) AND NOT (length(p.variety) >= 4 AND contains(upper(trim(t.line)), p.variety))""",
    "order_sheets": f"""WITH {_LINES}, existing AS (SELECT DISTINCT invoice, provider_id FROM lines WHERE line_no = 1 AND stems > 40)
SELECT invoice, provider_id, line_no, article_id, stems AS units, greatest(bunches, 1) AS packs, line_total AS price FROM lines l WHERE match_status = 'ok' AND article_id IS NOT NULL
AND NOT EXISTS (SELECT 1 FROM existing e WHERE e.invoice = l.invoice AND e.provider_id = l.provider_id) AND invoice IN (SELECT o_orderkey FROM orders)""",
    "upsert_latest": f"WITH {_LOG} SELECT key, kind, confidence, event_id FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY ts DESC, event_id DESC) = 1",
    "page_confidence": rf"""WITH {_TEXT}, p AS (SELECT doc_id, length(line) AS chars, (0.5::DOUBLE + (line_no % 5) / 10::DOUBLE) AS confidence, length(line) >= 40 AND len([w FOR w IN regexp_split_to_array(line, '[\t\n\x0B\f\r ]+') IF w <> '']) >= 15
AND length(regexp_replace(line, '[^A-Za-z0-9]', '', 'g')) >= 0.35::DOUBLE * length(line) AS native FROM text_lines)
SELECT doc_id, count(*) AS n_pages, count(*) FILTER (native) AS n_native, sum(chars)::BIGINT AS n_chars, sum((confidence * greatest(chars, 1))::DECIMAL(38,4))::DOUBLE / sum(greatest(chars, 1)) AS confidence,
CASE WHEN count(*) FILTER (native) = count(*) THEN 'native' WHEN count(*) FILTER (native) > 0 THEN 'mixed' ELSE 'scan' END AS source FROM p GROUP BY doc_id""",
    "canonical_keys": f"WITH {_ARTICLES} SELECT id, concat_ws('|', family, trim(regexp_replace(regexp_replace(upper(variety || '. ' || brand), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')), size, pack, 'A1') AS match_key FROM articles",
    "expected_names": f"""WITH {_ARTICLES}, x AS (SELECT id, variety AS v, CASE WHEN id % 11 = 0 THEN 0 ELSE size END AS s, pack AS p, CASE WHEN id % 3 = 0 THEN '' ELSE 'FANCY' END AS g, CASE WHEN id % 2 = 0 THEN 'EC' ELSE 'COL' END AS o, id % 7 AS k FROM articles)
SELECT id, CASE k WHEN 0 THEN 'ROSA ' || o || ' ' || v || CASE WHEN s > 0 AND p > 0 THEN format(' {{}}CM {{}}U', s, p) ELSE '' END
WHEN 1 THEN concat_ws(' ', CASE WHEN p = 10 THEN 'MINI CLAVEL COL' ELSE 'CLAVEL COL' END, nullif(g, ''), {_colors('v')}, format('{{}}CM {{}}U', CASE WHEN s > 0 THEN s ELSE 70 END, p))
WHEN 2 THEN 'HYDRANGEA ' || v || CASE WHEN s > 0 AND p > 0 THEN format(' {{}}CM {{}}U', s, p) ELSE '' END
WHEN 3 THEN CASE WHEN s > 0 THEN concat_ws(' ', 'ALSTROMERIA', o, nullif(g, ''), v) || format(' {{}}CM {{}}U', s, p) ELSE 'ALSTROMERIA ' || o || ' ' || v END
WHEN 4 THEN 'PANICULATA ' || v WHEN 5 THEN 'CRISANTEMO ' || v || CASE WHEN s > 0 THEN format(' {{}}CM {{}}U', s, p) ELSE '' END ELSE v END AS expected FROM x""",
    "color_translation": f"WITH {_ARTICLES} SELECT id, {_colors('variety')} AS translated, 'E' || variety || ' N B' AS folded FROM articles",
    "number_parsing": "SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::DOUBLE AS us, o_totalprice::DECIMAL(18,2)::DOUBLE AS eu, o_totalprice::DECIMAL(18,2)::DOUBLE AS plain, o_totalprice::DECIMAL(18,2)::DOUBLE AS printed FROM orders",
    "provider_detection": "WITH p AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {i})" for i, (a, b) in enumerate(PROVIDER_PATTERNS)) + """) v(provider, pattern, ord))
SELECT doc_id, arg_min(provider, instr(lower(text), lower(pattern)) * 1000 + ord) AS provider, min(instr(lower(text), lower(pattern)))::INT AS position FROM documents, p WHERE instr(lower(text), lower(pattern)) > 0 GROUP BY doc_id""",
    "brand_mining": f"WITH {_LINES}, {_MINED} SELECT * FROM mined",
    "own_brands": f"""WITH {_LINES}, {_MINED}, every AS (SELECT provider_id, token AS brand FROM mined WHERE provider_id NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 10 = 3)
UNION SELECT * FROM (VALUES {", ".join(f"({a}, '{b}')" for a, b in MANUAL_BRANDS)}) v) SELECT provider_id, string_agg(brand, ',' ORDER BY brand) AS brands FROM every WHERE brand NOT IN ('ROD', 'BOLT') GROUP BY 1""",
    "catalog_index": rf"""WITH {_ARTICLES} SELECT id, name, regexp_extract(name, '([0-9]+)CM', 1)::INT AS name_size, regexp_extract(name, '([0-9]+)U', 1)::INT AS name_pack, trim(regexp_extract(name, '^(.*?) [0-9]+CM', 1)) AS name_variety,
regexp_extract(name, '[0-9]+U (.+)$', 1) AS name_brand, regexp_matches(name, '[0-9]U$') AS generic, starts_with(reference, 'F') AS matchable FROM articles""",
    "synonym_lookup": f"""WITH {_ARTICLES}, {_REQUESTS}, links AS (SELECT variety, size, CASE WHEN id % 2 = 0 THEN 0 ELSE pack END AS pack, min(id) AS article_id FROM articles GROUP BY 1, 2, 3)
SELECT line_id, coalesce(e.article_id, z.article_id) AS found, CASE WHEN e.article_id IS NOT NULL THEN 'exact' WHEN z.article_id IS NOT NULL THEN 'pack 0' ELSE 'none' END AS how
FROM requests r LEFT JOIN links e ON r.variety = e.variety AND r.size = e.size AND r.pack = e.pack LEFT JOIN links z ON r.variety = z.variety AND r.size = z.size AND z.pack = 0""",
    "priority_search": f"""{_LINK}, mine AS (SELECT line_id, {{'rung': CASE WHEN same THEN 2 ELSE 5 END, 'gap': 0, 'id': id}} AS x FROM rungs WHERE of_provider = provider_id),
with_mine AS (SELECT line_id, min(x) AS x FROM (SELECT * FROM stepped UNION ALL SELECT * FROM mine) GROUP BY line_id) SELECT line_id, x.id AS article_id, x.rung, x.gap FROM with_mine""",
    "branded_exact_match": f"{_LINK} SELECT line_id, article_id, source FROM exacts",
    "rose_prefix_match": f"{_LINK} SELECT line_id, count(*) AS n, min(article_id) AS first_id FROM prefixed GROUP BY 1",
    "candidate_union_dedupe": f"{_LINK} SELECT * FROM candidates",
    "hard_vetoes": f"{_LINK}, {_VETO} SELECT line_id, article_id, array_to_string(vetoes, ',') AS vetoes FROM vetoed",
    "evidence_scores": f"{_LINK}, {_VETO}, {_SCORE} SELECT line_id, article_id, source, score FROM graded",
    "link_decisions": f"""{_LINK}, {_VETO}, {_SCORE}, ranked AS (SELECT *, row_number() OVER w AS place, lead(score) OVER w AS second FROM graded WINDOW w AS (PARTITION BY line_id ORDER BY score DESC, list_position(['exact', 'branded', 'priority', 'prefix'], source), article_id))
SELECT line_id, article_id, source, score, CASE WHEN score IS NOT NULL THEN round(score - coalesce(second, 0), 3) END AS margin, CASE WHEN score IS NULL THEN 'sin_match' WHEN score >= 0.7 THEN CASE WHEN coalesce(second, 0) < 0.7 OR round(score - coalesce(second, 0), 3) >= CASE WHEN own_brand THEN 0.02::DOUBLE WHEN size = a_size THEN 0.05::DOUBLE ELSE 0.1::DOUBLE END THEN 'ok' ELSE 'ambiguous_match' END
WHEN score >= 0.5 THEN 'ambiguous_match' ELSE 'sin_match' END AS status FROM (SELECT line_id FROM requests) q LEFT JOIN (SELECT * FROM ranked WHERE place = 1) r USING (line_id)""",
    "variety_strips": f"WITH {_CAT}, {_STRIPS} SELECT line_id, source, ord::INT AS ord, variety FROM strips",
    "linker_candidates": f"{_LINKER} SELECT line_id, article_id, source, percent, status FROM cands",
    "linker_vetoes": f"{_LINKER}, {_VETOED} SELECT line_id, article_id, array_to_string(vetoes, ',') AS vetoes FROM beside",
    "linker_scores": f"{_LINKER}, {_VETOED}, {_GRADED} SELECT line_id, article_id, source, points, score FROM raised",
    "linker_decisions": f"""{_LINKER}, {_VETOED}, {_GRADED}, {_DECIDED} SELECT line_id, CASE WHEN stand_in THEN mixto_id WHEN status = 'sin_match' THEN NULL WHEN swap THEN b_id ELSE a_id END AS article_id, CASE WHEN stand_in THEN 'spray_mixto' WHEN status = 'sin_match' THEN NULL WHEN swap THEN b_source ELSE a_source END AS source,
coalesce(CASE WHEN stand_in THEN 0 WHEN swap THEN b_score ELSE a_score END, 0)::INT AS score, coalesce(CASE WHEN stand_in THEN 0 ELSE a_score - b_score END, 0)::INT AS margin, status, CASE WHEN status <> 'sin_match' AND NOT stand_in THEN why0 ELSE '' END AS why FROM d6""",
    "history_stats": f"""WITH {_LINES}, k AS (SELECT provider_id, article_id, arg_max(match_status, {{'i': invoice, 'l': line_no}}) AS s FROM lines GROUP BY 1, 2), x AS (SELECT count(*) AS n_keys, count(*) FILTER (s = 'ok') AS ok_keys FROM k)
SELECT count(DISTINCT invoice) AS invoices, count(*) FILTER (match_status = 'ok') AS ok, count(*) FILTER (match_status <> 'ok') AS failed, sum(amount)::DOUBLE AS total, any_value(n_keys) AS n_keys, any_value(ok_keys) AS ok_keys, round(any_value(ok_keys)::DOUBLE / any_value(n_keys), 4) AS key_rate FROM lines, x""",
    "shown_stats": f"WITH {_LINES}, {_BOXED} SELECT invoice, count(*) FILTER (match_status = 'ok') AS ok, count(*) FILTER (match_status = 'sin_match') AS unmatched, count(*) FILTER (match_status = 'ambiguous_match') AS review, sum(stems)::BIGINT AS stems, sum(amount)::DOUBLE AS total FROM boxed WHERE box_type <> 'MIX' GROUP BY 1",
    "synonym_kpis": f"WITH {_CAT} SELECT status, count(*) AS n, count(DISTINCT provider_id) AS providers, count(DISTINCT article_id) AS articles FROM store GROUP BY 1",
    "batch_restats": f"""WITH {_LINES}, b AS (SELECT invoice, line_no, min({{'a': article_id, 's': match_status}}) AS x FROM lines GROUP BY 1, 2), c AS (SELECT invoice, x.s AS s, x.a AS a, x.a + CASE WHEN line_no = 3 THEN 1 ELSE 0 END AS na, CASE WHEN x.s = 'sin_match' AND x.a % 2 = 0 THEN 'ok' ELSE x.s END AS ns FROM b)
SELECT invoice, count(*) FILTER (s = 'ok') AS ok_before, count(*) FILTER (ns = 'ok') AS ok_after, count(*) FILTER (a <> na OR s <> ns) AS changed FROM c GROUP BY 1""",
    "last_audit": f"WITH {_LOG} SELECT event_id, ts, kind FROM log ORDER BY ts DESC, event_id DESC LIMIT 20",
    "batch_states": f"""WITH {_LOG}, b AS (SELECT key AS batch, max(ts) AS last, count(*) FILTER (kind = 'confirm') AS done FROM log WHERE kind <> 'correct' GROUP BY 1)
SELECT batch, CASE WHEN done > 0 THEN 'done' WHEN last < TIMESTAMP '{LATE}' - INTERVAL 30 MINUTE THEN 'stale' ELSE 'running' END AS state FROM b""",
    "spray_roses": rf"WITH {_CAT} SELECT line_id, species = 'ROSES' AND (pack = 10 OR regexp_matches(upper(variety || CASE WHEN line_id % 13 = 0 THEN ' spray' ELSE '' END), '\b(?:SP|SPRAY)\b')) AS spray FROM ll",
    "list_filters": f"WITH {_CAT} SELECT provider_id, v AS variety_key, article_id, 'green' AS badge, 'auto-fuzzy' AS origin FROM store WHERE status = 'aprendido_confirmado' AND contains(lower(v || ' ' || species), 'ring')",
    "species_pool_keys": f"""WITH {_CAT}, n AS (SELECT id, upper(CASE WHEN id % 11 = 0 THEN 'ROSA ' || variety ELSE name END) AS n FROM cat),
p AS (SELECT id, n, unnest(CASE {" ".join(f"WHEN starts_with(n, '{k}') THEN {v!r}" for k, v in reports.POOLS.items())} ELSE ['OTHER'] END) AS pool FROM n) SELECT id, pool, CASE {" ".join(f"WHEN starts_with(n, '{k}') THEN substr(n, {len(k) + 1})" for k in reports.POOLS)} ELSE n END AS rest FROM p""",
    "known_brands": "SELECT DISTINCT brand FROM (SELECT upper(s_name) AS brand FROM supplier UNION ALL SELECT w FROM (SELECT unnest(regexp_split_to_array(upper(s_name), '[^A-Z0-9]+')) AS w FROM supplier) x WHERE length(w) >= 4 UNION ALL SELECT unnest(['MYSTIC', 'UMA'])) y",
    "resolved_links": f"""WITH a AS (SELECT p_partkey AS id, 'E' || (p_partkey % 700) AS d FROM part), n AS (SELECT d, min(id) AS new_id FROM a GROUP BY 1)
SELECT id AS link_id, coalesce(new_id, id) AS article_id, new_id IS NOT NULL AND new_id <> id AS moved FROM (SELECT id, CASE WHEN id % 5 = 0 THEN 'gone' ELSE d END AS d FROM a) l LEFT JOIN n USING (d)""",
    "graded_roses": f"""WITH {_CAT}, r AS (SELECT * FROM cat WHERE species = 'ROSES'), n AS (SELECT concat_ws(' ', 'ROSA COL', variety, CASE WHEN id % 3 = 0 THEN CASE WHEN id % 2 = 0 THEN 'FANCY' ELSE 'SELECT' END END, format('{{}}CM {{}}U', size, pack)) AS name, min(id) AS id FROM r GROUP BY 1),
k AS (SELECT id AS line_id, 0 AS n, concat_ws(' ', 'ROSA COL', variety, 'FANCY', format('{{}}CM {{}}U', size, pack)) AS name FROM r UNION ALL SELECT id, 1, concat_ws(' ', 'ROSA COL', variety, format('{{}}CM {{}}U', size, pack)) FROM r)
SELECT line_id, arg_min(n.id, k.n) AS article_id, min(k.n) = 0 AS with_grade FROM k JOIN n USING (name) GROUP BY 1""",
    "variety_forms": f"""WITH {_ARTICLES}, v AS (SELECT id, CASE WHEN id % 4 = 0 THEN 'GARDEN ROSE ' || variety ELSE variety END AS v FROM articles), {_FORMS}
SELECT id, string_agg(form, '|' ORDER BY i) AS forms FROM forms GROUP BY 1""",
    "variety_search": f"""WITH {_ARTICLES}, {_REQUESTS}, a AS (SELECT variety AS form, size AS s, min(id) AS id FROM articles GROUP BY 1, 2), v AS (SELECT line_id AS id, variety AS v FROM requests), {_FORMS},
d AS (SELECT f.id AS line_id, r.size, form, row_number() OVER (PARTITION BY f.id ORDER BY i) - 1 AS n FROM forms f JOIN requests r ON r.line_id = f.id),
j AS (SELECT line_id, id, min({{'off': (s <> size)::INT, 'n': n}}) AS x FROM d JOIN a USING (form) GROUP BY 1, 2) SELECT line_id, (row_number() OVER (PARTITION BY line_id ORDER BY x, id))::INT AS place, id AS article_id FROM j QUALIFY row_number() OVER (PARTITION BY line_id ORDER BY x, id) <= 5""",
    "alternatives": f"""WITH {_ARTICLES}, {_REQUESTS}, j AS (SELECT r.line_id, a.id, CASE WHEN a.variety = r.variety THEN 10 WHEN contains(a.variety, r.variety) OR contains(r.variety, a.variety) THEN 3 ELSE 0 END + CASE WHEN a.size = r.size THEN 5 ELSE 0 END + CASE WHEN a.pack = r.pack THEN 3 ELSE 0 END + CASE WHEN a.brand = r.brand THEN 2 ELSE 0 END AS points
FROM requests r JOIN articles a ON string_split(r.variety, ' ')[1] = string_split(a.variety, ' ')[1]) SELECT line_id, (row_number() OVER w)::INT AS place, id AS article_id, points FROM j WHERE points >= 5 WINDOW w AS (PARTITION BY line_id ORDER BY points DESC, id) QUALIFY row_number() OVER w <= 5""",
    "header_vocabulary": rf"""WITH {_TEXT}, c AS (SELECT doc_id, unnest(string_split('Stems. Unit(cid:12)Price, ' || line, ' ')) AS cell, unnest(range(len(string_split('Stems. Unit(cid:12)Price, ' || line, ' '))))::INT AS position FROM text_lines WHERE line_no = 0),
h AS (SELECT doc_id, position, trim(regexp_replace(regexp_replace(upper(regexp_replace(cell, '\(cid:[0-9]+\)', '', 'g')), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS h FROM c)
SELECT doc_id, position, CASE {" ".join(f"WHEN contains(h, '{w}') OR (length(h) >= 3 AND contains('{w}', h)) THEN '{f}'" for w, f in reports.HEADER_WORDS.items())} END AS field FROM h WHERE CASE {" ".join(f"WHEN contains(h, '{w}') OR (length(h) >= 3 AND contains('{w}', h)) THEN 1" for w in reports.HEADER_WORDS)} ELSE 0 END = 1""",
    "similar_layouts": f"""WITH {_TEXT}, {_PRINTS}, x AS (SELECT p.doc_id, n_fields, separator, list_distinct(string_split(string_split(text, chr(10))[1], ' ')) AS h, lang FROM prints p JOIN documents d USING (doc_id)), f AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY n_fields ORDER BY doc_id) = 1)
SELECT x.doc_id, coalesce(len(list_intersect(x.h, f.h))::DOUBLE / len(list_distinct(list_concat(x.h, f.h))) >= 0.6 AND x.lang = f.lang AND (x.separator = '' OR f.separator = '' OR x.separator = f.separator), false) AS similar FROM x JOIN f USING (n_fields)""",
    "positional_rules": rf"""WITH {_TEXT}, c AS (SELECT unnest(string_split(line, ' ')) AS cell, unnest(range(len(string_split(line, ' '))))::INT AS position FROM text_lines), k AS (SELECT position, CASE WHEN regexp_matches(cell, '^\$?[0-9]+[.,][0-9]+$') THEN 'price' WHEN regexp_matches(cell, '^[0-9]+$') THEN 'count' WHEN regexp_matches(cell, '[A-Za-z]') THEN 'text' ELSE 'other' END AS kind, length(cell) AS len FROM c),
g AS (SELECT position, kind, count(*) AS n, sum(len)::BIGINT AS letters FROM k GROUP BY 1, 2), m AS (SELECT *, sum(n) OVER (PARTITION BY position) AS cells FROM g QUALIFY row_number() OVER (PARTITION BY position ORDER BY n DESC, kind DESC) = 1)
SELECT position, CASE WHEN kind = 'text' AND row_number() OVER (ORDER BY (kind = 'text') DESC, letters::DOUBLE / n DESC, position) = 1 THEN 'variety' ELSE kind END AS field, round(n::DOUBLE / cells, 4) AS share FROM m""",
    "line_pattern": f"WITH {_TEXT}, h AS (" + " UNION ALL ".join(f"SELECT {i} AS pattern_no, count(*) FILTER (regexp_matches(line, '{p}')) AS hits, count(*) AS n FROM text_lines" for i, p in enumerate(LINE_PATTERNS)) + ") SELECT pattern_no, hits, round(hits::DOUBLE / n, 4) AS share FROM h WHERE hits >= 0.3 * n ORDER BY hits DESC, pattern_no LIMIT 1",
    "link_likeness": rf"""WITH {_CAT}, j AS (SELECT l.line_id, l.v, l.size, c.size AS s, {_canon("c.name")} AS a FROM ll l JOIN cat c ON c.id = l.line_id), k AS (SELECT *, trim(regexp_replace(regexp_replace(a, '^(?:ROSA (?:EC|COL)|ROSA|CLAVEL COL|CLAVEL|HYDRANGEA|PANICULATA|ALSTROMERIA) ', ''), ' [0-9]+CM.*$', '')) AS av,
  array_to_string([coalesce(element_at({_MAP}, w)[1], w) FOR w IN string_split(v, ' ')], ' ') AS vt FROM j),
s AS (SELECT *, CASE WHEN contains(a, v) OR v = av THEN 100 WHEN contains(av, v) OR contains(v, av) THEN 85 WHEN contains(a, vt) OR vt = av THEN 95 WHEN contains(av, vt) OR contains(vt, av) THEN 85
  WHEN abs(length(v) - length(av)) <= 2 AND 100 * len([i FOR i IN range(1, greatest(least(length(v), length(av)), 1) + 1) IF substr(v, i::BIGINT, 1) = substr(av, i::BIGINT, 1)]) >= 75 * greatest(length(v), length(av))
  THEN floor(100 * len([i FOR i IN range(1, greatest(least(length(v), length(av)), 1) + 1) IF substr(v, i::BIGINT, 1) = substr(av, i::BIGINT, 1)]) / greatest(length(v), length(av)))
  ELSE least(floor(len(list_intersect(list_distinct(list_concat(string_split(v, ' '), string_split(vt, ' '))), list_distinct(list_concat(string_split(av, ' '), string_split(a, ' '))))) / least(len(list_distinct(string_split(v, ' '))), len(list_distinct(string_split(av, ' ')))) * 85), 85) END::INT AS score FROM k)
SELECT line_id, score, array_to_string([x FOR x IN [CASE WHEN score < 50 THEN 'unlike' END, CASE WHEN size > 0 AND s > 0 AND size <> s THEN 'size' END] IF x IS NOT NULL], ',') AS reasons FROM s""",
    "clean_texts": r"SELECT s_suppkey, trim(regexp_replace(regexp_replace(upper(s_name), '[^A-Z0-9 ]+', ' ', 'g'), ' +', ' ', 'g')) AS header, regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS name FROM supplier",
    "fuzzy_topk": f"""WITH RECURSIVE {_ARTICLES}, alike_in AS (SELECT DISTINCT a.family AS pool, reverse(a.variety) AS q, b.variety AS n FROM articles a JOIN articles b USING (family)), {_ALIKE}
SELECT pool, q AS query, n AS name, round(ratio, 3) AS ratio, place FROM alike""",
    "levenshtein_topk": """WITH n AS (SELECT DISTINCT p_name AS name FROM part), d AS (SELECT a.name, b.name AS near, levenshtein(a.name, b.name) AS distance FROM n a JOIN n b ON a.name <> b.name AND abs(length(a.name) - length(b.name)) <= 4)
SELECT name, near, distance::INT AS distance, (row_number() OVER (PARTITION BY name ORDER BY distance, near))::INT AS place FROM d WHERE distance <= 4 QUALIFY row_number() OVER (PARTITION BY name ORDER BY distance, near) <= 3""",
    "article_search": f"WITH {_ARTICLES}, q AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}')" for s in SEARCHES) + r""") v(q)), j AS (SELECT q, id, name, CASE WHEN reference = upper(q) THEN 1 WHEN starts_with(reference, upper(q)) THEN 2
WHEN len([w FOR w IN string_split(upper(q), ' ') IF length(w) >= 2 AND NOT contains(name, w)]) = 0 AND len([w FOR w IN string_split(upper(q), ' ') IF length(w) >= 2]) > 0 THEN 3 END AS kind FROM articles, q)
SELECT q, (row_number() OVER w)::INT AS place, id, kind FROM j WHERE kind IS NOT NULL WINDOW w AS (PARTITION BY q ORDER BY kind, length(name), id) QUALIFY row_number() OVER w <= 10""",
    "suggest_candidates": f"""WITH {_ARTICLES}, {_REQUESTS}, j AS (SELECT r.line_id, a.id, floor(len([w FOR w IN string_split(r.variety, ' ') IF length(w) >= 2 AND contains(a.name, w)]) * 60 / len([w FOR w IN string_split(r.variety, ' ') IF length(w) >= 2]))::INT
+ CASE WHEN r.family = a.family THEN 15 ELSE 0 END + CASE WHEN r.size = a.size THEN 10 ELSE 0 END + CASE WHEN r.pack = a.pack THEN 8 ELSE 0 END AS points FROM requests r JOIN articles a ON string_split(r.variety, ' ')[1] = string_split(a.variety, ' ')[1])
SELECT line_id, (row_number() OVER w)::INT AS place, id AS article_id, points FROM j WHERE points >= 25 WINDOW w AS (PARTITION BY line_id ORDER BY points DESC, id) QUALIFY row_number() OVER w <= 5""",
    "price_reconcile": f"""WITH {_LINES}, sheets AS (SELECT provider_id, invoice FROM (SELECT DISTINCT provider_id, invoice FROM lines) QUALIFY row_number() OVER (PARTITION BY provider_id ORDER BY invoice DESC) <= 20),
refs AS (SELECT provider_id, article_id, avg(amount::DOUBLE / stems) AS reference FROM lines JOIN sheets USING (provider_id, invoice) WHERE stems > 0 GROUP BY 1, 2),
j AS (SELECT invoice, line_no, article_id, provider_id, reference, round(amount::DOUBLE / stems / reference - 1, 4) AS change FROM lines JOIN refs USING (provider_id, article_id) WHERE match_status = 'ok' AND stems > 0 AND amount > 0 AND reference > 0)
SELECT invoice, line_no, article_id, provider_id, round(reference, 4) AS reference, change, CASE WHEN abs(change) > 0.3 THEN 'severe' WHEN abs(change) > 0.15 THEN 'notable' ELSE 'none' END AS deviation FROM j""",
    "price_timeline": f"""WITH {_LINES}, {_HEADERS}, j AS (SELECT article_id, date_trunc('month', dated)::DATE AS month, amount::DOUBLE / stems AS price FROM lines JOIN headers USING (invoice) WHERE stems > 0), s AS (SELECT article_id, avg(price) AS mean, stddev_samp(price) AS deviation FROM j GROUP BY 1)
SELECT article_id, month, count(*) AS n, avg(price) AS mean, min(price) AS low, max(price) AS high, count(*) FILTER (abs(price - s.mean) > 2 * deviation) AS n_far FROM j JOIN s USING (article_id) GROUP BY 1, 2""",
    "provider_article_usage": f"WITH {_LINES} SELECT provider_id, article_id, count(*) AS n FROM lines WHERE match_status <> 'sin_match' GROUP BY 1, 2",
    "shadow_asof": f"WITH {_LOG}, {_ASOF} SELECT * FROM matched",
    "shadow_accuracy": f"""WITH {_LOG}, {_ASOF}, c AS (SELECT key, count(*) FILTER (kind = 'confirm' AND proposal_id IS NOT NULL) AS confirmed, count(*) FILTER (kind = 'correct' AND proposal_id IS NOT NULL) AS corrected, count(*) FILTER (proposal_id IS NULL) AS rescued FROM matched GROUP BY 1)
SELECT *, CASE WHEN confirmed + corrected > 0 THEN round(confirmed::DOUBLE / (confirmed + corrected), 4) END AS accuracy FROM c""",
    "shadow_backlog": f"""WITH {_LOG} SELECT key, article_id, event_id, confidence FROM log l WHERE kind = 'proposal' AND NOT EXISTS (SELECT 1 FROM log d WHERE d.key = l.key AND d.article_id = l.article_id AND d.kind IN ('confirm', 'correct'))
QUALIFY row_number() OVER (PARTITION BY key, article_id ORDER BY ts DESC, event_id DESC) = 1""",
    "missing_articles": f"""WITH {_LOG} SELECT article_id, count(*) FILTER (kind = 'correct') AS rescues, count(*) FILTER (kind = 'proposal') AS pending, first(key ORDER BY ts, event_id) AS first_key,
3 * count(*) FILTER (kind = 'correct') + count(*) FILTER (kind = 'proposal') AS score FROM log GROUP BY 1""",
    "link_states": f"""WITH {_LOG}, k AS (SELECT key, article_id, CASE event_id % 40 WHEN 0 THEN 'delete' WHEN 1 THEN 'manual' ELSE kind END AS kind, ts FROM log WHERE article_id IS NOT NULL),
people AS (SELECT *, said IS NOT NULL AND (gone IS NULL OR said >= gone) AS manual FROM (SELECT key, max(ts) FILTER (kind = 'delete') AS gone, max(ts) FILTER (kind = 'manual') AS said,
  arg_max(article_id, {{'ts': ts, 'minus': -article_id}}) FILTER (kind = 'manual') AS chosen FROM k WHERE kind IN ('manual', 'delete') GROUP BY key) x),
e AS (SELECT k.*, p.manual, p.chosen, p.said FROM k LEFT JOIN people p USING (key) WHERE kind IN ('proposal', 'confirm', 'correct') AND (gone IS NULL OR ts > gone)),
counts AS (SELECT key, article_id, count(*) FILTER (kind = 'confirm') AS confirmed, count(*) FILTER (kind = 'correct') AS corrected, count(*) FILTER (kind = 'proposal') AS hits
  FROM e WHERE coalesce(NOT manual OR (article_id = chosen AND ts >= said), true) GROUP BY 1, 2),
states AS (SELECT *, CASE WHEN corrected >= 2 THEN 'rechazado' WHEN corrected = 1 THEN 'ambiguo' WHEN confirmed >= 1 OR hits >= 2 THEN 'aprendido_confirmado' ELSE 'aprendido_en_prueba' END AS status FROM counts),
graded AS (SELECT *, {_TRUSTED} AS trust FROM (SELECT *, {_BASE} AS b FROM states) x),
one AS (SELECT * FROM graded QUALIFY row_number() OVER (PARTITION BY key ORDER BY trust DESC, article_id) = 1),
joined AS (SELECT coalesce(o.key, p.key) AS key, coalesce(p.chosen, o.article_id) AS article_id, coalesce(confirmed, 0)::BIGINT AS confirmed, coalesce(corrected, 0)::BIGINT AS corrected, coalesce(hits, 0)::BIGINT AS hits,
  CASE WHEN p.chosen IS NULL THEN o.status WHEN coalesce(corrected, 0) >= 2 THEN 'rechazado' WHEN coalesce(corrected, 0) = 1 THEN 'ambiguo' ELSE 'manual_confirmado' END AS status
  FROM one o FULL JOIN (SELECT key, chosen FROM people WHERE manual) p ON p.key = o.key)
SELECT key, article_id, confirmed, corrected, hits, status, {_TRUSTED} AS trust FROM (SELECT *, {_BASE} AS b FROM joined) y""",
    "trust_scores": f"""WITH {_LOG}, {_FOLD} SELECT *, round(CASE WHEN corrected > 0 THEN greatest(0.1::DOUBLE, b - 0.15::DOUBLE * corrected) WHEN confirmed > 1 THEN least(0.98::DOUBLE, b + 0.05::DOUBLE * least(confirmed - 1, 5)) ELSE b END, 3) AS trust
FROM (SELECT *, CASE status WHEN 'manual_confirmado' THEN 0.98::DOUBLE WHEN 'aprendido_confirmado' THEN 0.85::DOUBLE WHEN 'aprendido_en_prueba' THEN 0.55::DOUBLE WHEN 'ambiguo' THEN 0.3::DOUBLE ELSE 0.0::DOUBLE END AS b FROM states)""".replace("SELECT *, round", "SELECT key, article_id, confirmed, corrected, hits, status, round"),
    "synonym_fold": f"WITH {_LOG}, {_FOLD} SELECT key, article_id, status, confirmed + corrected + hits AS n_events FROM states",
    "synonym_audit": f"WITH {_ARTICLES} SELECT variety, size, count(*) AS n_links, count(DISTINCT id) AS n_articles, min(id) AS first_id FROM articles GROUP BY 1, 2 HAVING count(DISTINCT id) > 1",
    "benchmark_rollup": f"WITH {_LINES}, {_CHECKED}, {_LANED}, {_ROLL} SELECT * FROM rates",
    "provider_verdicts": f"""WITH {_LINES}, {_HEADERS}, {_BALANCE}, samples AS (SELECT provider_id, invoice, count(*) FILTER (extraction_source <> 'rescue') AS parsed, count(*) FILTER (extraction_source = 'rescue') AS rescued FROM lines GROUP BY 1, 2),
m AS (SELECT provider_id, count(*) AS samples, count(*) FILTER (header_ok IS NOT NULL) AS detected, count(*) FILTER (parsed + rescued > 0) AS parsed_any, count(*) FILTER (header_ok) AS totals_ok, sum(parsed)::BIGINT AS total_parsed, sum(rescued)::BIGINT AS total_rescued FROM samples LEFT JOIN balance USING (invoice) GROUP BY 1)
SELECT *, CASE WHEN samples = 0 THEN 'SIN_MUESTRAS' WHEN detected < samples THEN 'NO_DETECTADO' WHEN parsed_any < samples THEN 'NO_PARSEA' WHEN totals_ok < samples * 0.6 AND samples > 1 THEN 'TOTALES_MAL' WHEN total_rescued > total_parsed THEN 'MUCHO_RESCATE' ELSE 'OK' END AS verdict FROM m""",
    "error_taxonomy": f"""WITH {_LINES}, {_HEADERS}, {_BALANCE}, {_CHECKED}, {_LANED}, {_ROLL}, s AS (SELECT provider_id, invoice, count(*) FILTER (extraction_source <> 'rescue') AS parsed, count(*) FILTER (extraction_source = 'rescue') AS rescued, min(extraction_confidence) AS confidence,
  count(*) FILTER (match_status = 'ambiguous_match') AS ambiguous, count(*) FILTER (match_status = 'sin_match') AS unmatched, count(*) FILTER (len(errors) > 0) AS invalid, count(*) FILTER (match_status = 'ok' AND link_confidence < 0.2::DOUBLE) AS wrong,
  count(*) FILTER (match_method <> 'exact' AND match_confidence < 0.85::DOUBLE) AS weak, count(*) FILTER (candidate_margin < 0.04::DOUBLE) AS ties FROM checked GROUP BY 1, 2), j AS (SELECT s.*, confidence < 0.7::DOUBLE AS ocr, header_ok FROM s LEFT JOIN balance USING (invoice)),
m AS (SELECT provider_id, count(*) AS n, count(*) FILTER (parsed = 0) AS zero, count(*) FILTER (parsed = 0 AND NOT ocr) AS native_zero, count(*) FILTER (ocr AND (parsed = 0 OR confidence < 0.6::DOUBLE)) AS bad_ocr, count(*) FILTER (parsed > 0 AND NOT coalesce(header_ok, false)) AS bad_total,
  sum(parsed)::BIGINT AS parsed, sum(rescued)::BIGINT AS rescued, sum(ambiguous)::BIGINT AS ambiguous, sum(unmatched)::BIGINT AS unmatched, sum(invalid)::BIGINT AS invalid, sum(wrong)::BIGINT AS wrong, sum(weak)::BIGINT AS weak, sum(ties)::BIGINT AS ties FROM j GROUP BY 1),
fm AS (SELECT s_suppkey AS provider_id, count(*) OVER (PARTITION BY CASE WHEN s_suppkey % 4 = 0 THEN 'shared' ELSE s_name END) AS sharing FROM supplier), mm AS (SELECT m.*, coalesce(sharing, 0) AS sharing FROM m LEFT JOIN fm USING (provider_id)),
f AS (SELECT provider_id, 'E1_PARSE_ZERO' AS category, CASE WHEN zero >= 0.5 * n THEN 'HIGH' ELSE 'MEDIUM' END AS severity, zero AS impact FROM mm WHERE zero > 0
  UNION ALL SELECT provider_id, 'E2_PARSE_PARTIAL', CASE WHEN rescued::DOUBLE / (parsed + rescued) > 0.3::DOUBLE THEN 'HIGH' WHEN rescued::DOUBLE / (parsed + rescued) > 0.1::DOUBLE THEN 'MEDIUM' ELSE 'LOW' END, rescued FROM mm WHERE rescued > 0 AND parsed > 0
  UNION ALL SELECT provider_id, 'E3_LAYOUT_COORDS', CASE WHEN native_zero >= 2 THEN 'HIGH' ELSE 'MEDIUM' END, native_zero FROM mm WHERE native_zero > 0 UNION ALL SELECT provider_id, 'E4_OCR_BAD', CASE WHEN bad_ocr >= 2 THEN 'HIGH' ELSE 'MEDIUM' END, bad_ocr FROM mm WHERE bad_ocr > 0
  UNION ALL SELECT provider_id, 'E5_TOTAL_HEADER', CASE WHEN bad_total <= 0.3 * n THEN 'LOW' ELSE 'MEDIUM' END, bad_total FROM mm WHERE bad_total > 0 UNION ALL SELECT provider_id, 'E6_MATCH_WRONG', CASE WHEN wrong >= 5 THEN 'HIGH' ELSE 'MEDIUM' END, wrong FROM mm WHERE wrong >= 2
  UNION ALL SELECT provider_id, 'E7_SYNONYM_DRIFT', CASE WHEN weak >= 10 THEN 'HIGH' WHEN weak >= 5 THEN 'MEDIUM' ELSE 'LOW' END, weak FROM mm WHERE weak >= 3 AND weak >= 0.2 * parsed
  UNION ALL SELECT provider_id, 'E8_AMBIGUOUS_LINK', CASE WHEN ambiguous >= 5 THEN 'HIGH' WHEN ambiguous >= 2 THEN 'MEDIUM' ELSE 'LOW' END, ambiguous FROM mm WHERE ambiguous >= 2 OR ties >= 3
  UNION ALL SELECT provider_id, 'E9_VALIDATION_FAIL', CASE WHEN invalid >= 5 THEN 'HIGH' WHEN invalid >= 2 THEN 'MEDIUM' ELSE 'LOW' END, invalid FROM mm WHERE invalid > 0 UNION ALL SELECT provider_id, 'E10_PROVIDER_COLLISION', 'LOW', 0 FROM mm WHERE sharing >= 2 AND unmatched > 0),
g AS (SELECT * FROM f UNION ALL SELECT provider_id, 'CLEAN', 'NONE', 0 FROM mm WHERE provider_id NOT IN (SELECT provider_id FROM f)),
h AS (SELECT g.*, CASE WHEN category = 'CLEAN' THEN 0.0::DOUBLE ELSE round((CASE severity WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 ELSE 1 END * CASE category {" ".join(f"WHEN '{k}' THEN {v}" for k, v in FAULT_WEIGHT.items())} ELSE 1 END + impact * 0.5::DOUBLE)
  * CASE WHEN auto_rate >= 0.85 THEN 0.4::DOUBLE WHEN auto_rate >= 0.7 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END, 3) END AS priority FROM g LEFT JOIN rates r ON r.provider_id = g.provider_id)
SELECT provider_id, category, severity, impact::BIGINT AS impact, priority, row_number() OVER (PARTITION BY provider_id ORDER BY priority DESC, category) = 1 AS dominant FROM h""",
    "golden_alignment": f"""WITH RECURSIVE {_LINES}, {_BOXED}, gold AS (SELECT invoice AS doc_id, line_no, variety, size, stems FROM boxed QUALIFY row_number() OVER (PARTITION BY invoice, line_no ORDER BY article_id, provider_id, amount) = 1),
found AS (SELECT doc_id, (8 - line_no)::INT AS line_no, variety, (size + line_no % 2)::INT AS size, stems FROM gold), {_WALK}
SELECT doc_id, gold_no, found_no, points FROM walked UNION ALL SELECT doc_id, line_no, NULL, NULL FROM gold ANTI JOIN (SELECT doc_id, gold_no AS line_no FROM walked) x USING (doc_id, line_no)
UNION ALL SELECT doc_id, NULL, line_no, NULL FROM found ANTI JOIN (SELECT doc_id, found_no AS line_no FROM walked) x USING (doc_id, line_no)""",
    "gold_metrics": f"""WITH RECURSIVE {_LINES}, {_BOXED}, gold AS (SELECT invoice AS doc_id, line_no, variety, size, stems, line_total, article_id FROM boxed QUALIFY row_number() OVER (PARTITION BY invoice, line_no ORDER BY article_id, provider_id, amount) = 1),
found AS (SELECT doc_id, line_no, variety, (size + CASE WHEN line_no % 3 = 0 THEN 10 ELSE 0 END)::INT AS size, stems, line_total * CASE WHEN line_no % 4 = 0 THEN 1.5::DOUBLE ELSE 1.01::DOUBLE END AS line_total, article_id + CASE WHEN line_no = 5 THEN 1 ELSE 0 END AS article_id FROM gold WHERE line_no < 7), {_WALK},
j AS (SELECT g.*, g.variety = f.variety AS v, g.size = f.size AS z, g.stems = f.stems AS s, abs(g.line_total - f.line_total) / greatest(abs(g.line_total), 0.01::DOUBLE) <= 0.02::DOUBLE AS l, g.article_id = f.article_id AS a
  FROM gold g LEFT JOIN walked w ON w.doc_id = g.doc_id AND w.gold_no = g.line_no LEFT JOIN found f ON f.doc_id = g.doc_id AND f.line_no = w.found_no),
m AS (SELECT 'variety' AS field, count(*) AS n, count(*) FILTER (v) AS ok FROM j UNION ALL SELECT 'size', count(*), count(*) FILTER (z) FROM j UNION ALL SELECT 'stems', count(*), count(*) FILTER (s) FROM j UNION ALL SELECT 'line_total', count(*), count(*) FILTER (l) FROM j
UNION ALL SELECT 'link', count(*) FILTER (article_id > 0), count(*) FILTER (article_id > 0 AND a) FROM j UNION ALL SELECT 'line', count(*), count(*) FILTER (v AND z AND s AND l AND a) FROM j) SELECT *, round(ok::DOUBLE / n, 4) AS accuracy FROM m""",
    "layout_rows": printed.SQL,
    "amount_texts": """SELECT l_orderkey AS doc_id, l_linenumber AS line_no, l_partkey AS key, l_suppkey AS other, (l_extendedprice * 100)::BIGINT / 100.0 AS amount FROM lineitem""",
    "printed_totals": "SELECT o_orderkey AS doc_id, CASE WHEN o_orderkey % 7 = 6 THEN 0.0 ELSE (o_totalprice * 100)::BIGINT / 100.0 END AS total FROM orders",
    "size_places": """SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity) AS line_no,
  CASE WHEN l_partkey % 11 = 10 THEN NULL ELSE 40 + 10 * (l_partkey % 5) END::INT AS size, l_quantity::INT AS count FROM lineitem""",
    "layout_switches": f"SELECT fmt, count(*) AS n FROM (SELECT [{', '.join(repr(n) for n in printed.LAYOUTS)}][l_orderkey % {len(printed.LAYOUTS)} + 1] AS fmt FROM lineitem JOIN part ON l_partkey = p_partkey) x WHERE fmt IN ('brissas', 'uma') GROUP BY fmt",
    "fingerprints": f"WITH {_TEXT}, {_PRINTS} SELECT * FROM prints",
    "fingerprint_clusters": f"""WITH {_TEXT}, {_PRINTS}, base AS (SELECT structure, min(doc_id) AS first_doc, arg_min(n_fields, doc_id) AS f FROM prints GROUP BY 1),
c AS (SELECT structure, min(first_doc) AS first_doc, count(*) FILTER (abs(n_fields - f) <= 2) AS n_docs, round(avg(points), 3) AS mean_points FROM prints JOIN base USING (structure) GROUP BY 1)
SELECT *, CASE WHEN n_docs >= 5 THEN 1.0::DOUBLE WHEN n_docs >= 3 THEN 0.8::DOUBLE WHEN n_docs >= 2 THEN 0.5::DOUBLE ELSE 0.3::DOUBLE END AS confidence FROM c""",
    "rule_inference": "WITH h AS (" + " UNION ALL ".join(f"SELECT '{f}' AS field, {i} AS pattern_no, count(*) AS n, count(*) FILTER (regexp_matches(substr(text, 1, 2000), '{p}')) AS hits FROM documents" for i, (f, p) in enumerate(HEADER_PATTERNS)) + ") SELECT field, pattern_no, hits, round(hits::DOUBLE / n, 4) AS share FROM h QUALIFY row_number() OVER (PARTITION BY field ORDER BY hits DESC, pattern_no) = 1",
    "column_typing": rf"""WITH {_TEXT}, cut AS (SELECT [w FOR w IN regexp_split_to_array(line, '[ \t]+') IF w <> ''] AS ws FROM text_lines WHERE regexp_matches(line, '[0-9]')),
cells AS (SELECT unnest(range(len(ws)))::INT AS position, unnest(ws) AS cell FROM cut),
m AS (SELECT position, count(*) AS n, round(count(*) FILTER (regexp_matches(cell, '^[0-9]+$'))::DOUBLE / count(*), 4) AS whole, round(count(*) FILTER (regexp_matches(cell, '^[0-9]+[.,][0-9]+$'))::DOUBLE / count(*), 4) AS "decimal",
  round(count(*) FILTER (regexp_matches(cell, '^[A-Za-z.,]+$'))::DOUBLE / count(*), 4) AS word, round(avg(length(cell)), 3) AS mean_length FROM cells GROUP BY 1)
SELECT *, CASE WHEN "decimal" > 0.7 THEN 'price' WHEN whole > 0.7 THEN 'count' WHEN word > 0.7 THEN 'text' ELSE 'mixed' END AS kind FROM m""",
    "rule_validation": f"""WITH {_LINES}, v AS (SELECT 'stems' AS field, stems::DOUBLE AS value, 1.0 AS a, 1000.0 AS b FROM lines UNION ALL SELECT 'price', line_total, 1.0, 50000.0 FROM lines UNION ALL SELECT 'size', CASE WHEN line_no > 5 THEN pack::DOUBLE END, 30.0, 120.0 FROM lines),
m AS (SELECT field, count(*) AS n, count(value) AS n_read, count(*) FILTER (value BETWEEN a AND b) AS n_plausible, count(DISTINCT value) AS n_distinct FROM v GROUP BY 1),
s AS (SELECT *, (CASE WHEN n_read >= 0.5 * n THEN 0.25 ELSE 0 END + CASE WHEN n_plausible >= 0.7 * n_read THEN 0.25 ELSE 0 END + CASE WHEN n_distinct > 1 THEN 0.25 ELSE 0 END + CASE WHEN n >= 3 THEN 0.25 ELSE 0 END)::DOUBLE AS score FROM m)
SELECT *, CASE WHEN score >= 0.85 THEN 'active' WHEN score >= 0.5 THEN 'active, review' WHEN score >= 0.25 THEN 'review' ELSE 'reject' END AS decision FROM s""",
    "carry_forward": rf"""WITH {_TEXT}, h AS (SELECT *, last_value(nullif(regexp_extract(trim(line), '^((?:\S+ ){{0,5}}\S+[.:])$', 1), '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS head FROM text_lines)
SELECT doc_id, line_no, 0 AS variant, regexp_extract(trim(line), '^(\S+) ', 1) AS first_word, head FROM h WHERE regexp_matches(trim(line), '^(\S+) ')""",
    "look_around": rf"""WITH {_TEXT}, h AS (SELECT *, lead({_BELOW}, 1) OVER w AS below, lag({_ABOVE}, 1) OVER w AS above FROM text_lines WINDOW w AS (PARTITION BY doc_id ORDER BY line_no))
SELECT doc_id, line_no, 0 AS variant, regexp_extract(trim(line), '^(\S+)', 1) AS first_word, below, above FROM h WHERE regexp_matches(trim(line), '^(\S+)')""",
    "template_rows": f"""WITH {_LINES}, {_BOXED} SELECT invoice AS doc_id, (row_number() OVER (PARTITION BY invoice ORDER BY line_no, article_id, provider_id, line_total))::INT AS line_no, 0 AS variant, raw AS variety, (size + 10)::DOUBLE AS size, stems::DOUBLE AS stems,
line_no::DOUBLE AS price, amount::DOUBLE AS total, 'QB' AS box_type FROM boxed""",
    "event_windows": f"WITH {_LOG} SELECT date_trunc('day', ts)::TIMESTAMP AS start, count(*) FILTER (kind = 'proposal') AS proposals, count(*) FILTER (kind = 'confirm') AS confirmed, count(*) FILTER (kind = 'correct') AS corrected FROM log GROUP BY 1",
    "sessions": f"""WITH {_LOG}, g AS (SELECT key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY key ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS fresh FROM log), s AS (SELECT key, ts, sum(fresh) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT key, min(ts)::TIMESTAMP AS start, count(*) AS n_events FROM s GROUP BY key, n""",
}
_RAW = "lined AS (SELECT l.*, upper(p_name) || ' ' || repeat(upper(p_brand), 14) AS raw FROM lines l JOIN part ON article_id = p_partkey)"


def _keyed_owner() -> str:
    cases = " ".join("WHEN " + " AND ".join(f"contains(lower(text), '{k}')" for k in keys[:3]) + f" THEN '{owner}'" for owner, keys in OWNERS)
    return f"owned AS (SELECT doc_id, source, text, CASE {cases} END AS owner FROM documents)"


ORACLE_SQL |= {
    "serialized_lines": f"""WITH {_LINES}, {_RAW} SELECT invoice, line_no, article_id, provider_id, substr(raw, 1, 120) AS raw, round(price_per_stem, 5) AS price, amount::VARCHAR AS line_total, round(extraction_confidence, 3) AS confidence,
'{{"match_status":"' || match_status || '","stems":' || stems || ',"pack":' || pack || '}}' AS state FROM lined""",
    "alias_unify": f"WITH {_ARTICLES}, a AS (SELECT id, p_retailprice AS price, pack FROM articles JOIN part ON id = p_partkey) SELECT id, coalesce(CASE WHEN id % 3 = 0 THEN price * 2 END, CASE WHEN id % 2 = 0 THEN price END) AS line_total, 0.5::DOUBLE AS match_confidence, pack FROM a",
    "line_patches": f"""WITH {_LINES}, l AS (SELECT invoice, line_no, min({{'s': stems, 'l': match_status}}) AS x, invoice + line_no AS n FROM lines GROUP BY 1, 2)
SELECT invoice, line_no, CASE WHEN n % 6 = 0 THEN x.s + 1 ELSE x.s END AS stems, CASE WHEN n % 3 <> 0 THEN x.l WHEN n % 5 = 0 THEN NULL WHEN n % 7 = 0 THEN repeat('AB', 32) ELSE x.l END AS label FROM l""",
    "restored_lines": "SELECT o_orderkey AS invoice, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey ELSE 0 END AS stems, CASE o_orderkey % 3 WHEN 0 THEN o_orderstatus WHEN 1 THEN '5' ELSE '?' END AS variety FROM orders",
    "line_confidence": f"""WITH {_LINES}, d AS (SELECT o_orderkey AS invoice, (o_orderkey % 7) / 10.0::DOUBLE AS c, CASE WHEN o_orderkey % 2 = 0 THEN 'ocr' ELSE 'native' END AS s FROM orders WHERE o_orderkey % 10 <> 0)
SELECT invoice, line_no, article_id, provider_id, CASE WHEN extraction_source = 'rescue' THEN least(coalesce(c, 1.0), extraction_confidence) ELSE coalesce(c, 1.0) END AS extraction_confidence, CASE WHEN extraction_source = 'rescue' THEN 'rescue' ELSE coalesce(s, extraction_source) END AS extraction_source FROM lines LEFT JOIN d USING (invoice)""",
    "preserve_edits": f"""WITH {_LINES}, {_RAW}, old AS (SELECT invoice AS doc_id, lower(trim(raw)) AS k, bool_or(line_no % 3 = 0) AS deleted, max(CASE WHEN line_no % 2 = 0 THEN 'EDITED' END) AS label FROM lined GROUP BY 1, 2),
new AS (SELECT invoice AS doc_id, lower(trim(raw)) AS k, line_total AS amount FROM lined WHERE stems > 10)
SELECT n.doc_id, n.k, n.amount, o.label, coalesce(o.deleted, false) AS deleted FROM new n LEFT JOIN old o USING (doc_id, k)
UNION ALL SELECT doc_id, k, NULL, label, deleted FROM old o WHERE deleted AND NOT EXISTS (SELECT 1 FROM new n WHERE n.doc_id = o.doc_id AND n.k = o.k)""",
    "durable_lookup": f"""WITH {_ARTICLES}, c AS (SELECT 'C' || (id % 500) AS code, min(id) AS id FROM articles GROUP BY 1), r AS (SELECT upper(reference) AS ref, min(id) AS id FROM articles GROUP BY 1)
SELECT o_orderkey AS want_id, coalesce(c.id, r.id) AS id, CASE WHEN c.id IS NOT NULL THEN 'code' WHEN r.id IS NOT NULL THEN 'reference' ELSE 'none' END AS how
FROM orders LEFT JOIN c ON c.code = 'C' || (o_orderkey % 700) LEFT JOIN r ON r.ref = 'F' || lpad((o_orderkey % 3000)::VARCHAR, 6, '0')""",
    "id_migration": f"""WITH {_ARTICLES}, one AS (SELECT name AS n, min(id) AS id FROM articles GROUP BY 1 HAVING count(*) = 1), cut AS (SELECT name[:-2] AS n, min(id) AS id FROM articles GROUP BY 1 HAVING count(*) = 1),
l AS (SELECT id AS link_id, CASE WHEN id % 2 = 0 THEN name ELSE name[:-2] END AS n FROM articles) SELECT link_id, coalesce(one.id, cut.id) AS id FROM l LEFT JOIN one ON l.n = one.n LEFT JOIN cut ON l.n = cut.n""",
    "orphan_merge": f"""WITH {_LINES}, {_MINED}, owners AS (SELECT article_id, min(provider_id) AS owner FROM lines GROUP BY 1),
l AS (SELECT CASE WHEN b.stems % 4 = 0 THEN 0 ELSE a.provider_id END AS p, upper(string_split(p_name, ' ')[-1]) AS variety, a.article_id, b.match_status AS status, b.stems AS uses FROM lines a JOIN part ON a.article_id = p_partkey JOIN lines b ON a.provider_id = b.provider_id AND a.article_id = b.article_id),
m AS (SELECT CASE WHEN p = 0 THEN coalesce(owner, 0) ELSE p END AS provider_id, variety, article_id, status, uses FROM l LEFT JOIN owners USING (article_id))
SELECT provider_id, variety, arg_min(article_id, list_position(['ok', 'ambiguous_match', 'sin_match'], status)::BIGINT * 1000000000 + article_id) AS article_id, arg_min(status, list_position(['ok', 'ambiguous_match', 'sin_match'], status)) AS status, sum(uses)::BIGINT AS uses FROM m GROUP BY 1, 2""",
    "key_rewrite": f"""WITH {_ARTICLES}, m AS (SELECT variety, size, (CASE WHEN pack = 5 THEN 25 ELSE pack END)::INT AS pack, CASE WHEN pack = 5 THEN 1 ELSE 0 END AS moved, id FROM articles)
SELECT variety, size, pack, arg_min(id, moved * 1000000000 + id) AS article_id, count(*) AS n FROM m GROUP BY 1, 2, 3""",
    "truncated_names": f"""WITH {_ARTICLES}, s AS (SELECT *, CASE WHEN id % 4 = 0 THEN substr(name, 1, 9) ELSE name END AS stored FROM articles) SELECT id, CASE WHEN NOT regexp_matches(stored, '[0-9]U') AND starts_with(name, trim(stored)) THEN name ELSE stored END AS name FROM s""",
    "provider_suffix": f"WITH {_ARTICLES} SELECT id, trim(regexp_replace(variety, '(?i)\\s+(rod|bolt|ring)\\s*$', '')) AS stripped FROM articles",
    "color_modifiers": f"""WITH {_ARTICLES} SELECT id, array_to_string(list_sort([w FOR w IN list_distinct([CASE id % 4 WHEN 0 THEN 'DARK' WHEN 1 THEN 'LIGHT' WHEN 2 THEN 'NEON' END, CASE WHEN id % 5 = 0 THEN 'CLARO' END]) IF w IS NOT NULL AND NOT (w = 'CLARO' AND id % 3 = 0)]), ',') AS missing FROM articles""",
    "match_confidence": f"WITH {_LINES} SELECT invoice, line_no, article_id, provider_id, CASE WHEN link_confidence = 0 THEN 1.0::DOUBLE ELSE link_confidence END * 1.0::DOUBLE * CASE WHEN extraction_confidence = 0 THEN 1.0::DOUBLE ELSE extraction_confidence END AS confidence FROM lines",
    "sql_export": f"""WITH {_ARTICLES}, l AS (SELECT id, format('({{}}, {{}}{{}}{{}}, {{}}, {{}})', id % 9, chr(39), replace(variety, ' ', chr(39) || chr(39) || ' '), chr(39), size, CASE WHEN id % 6 = 0 THEN 0 ELSE id END) AS v FROM articles)
SELECT id AS link_id, CASE WHEN id % 6 = 0 OR id = 0 THEN '-- pending ' || v ELSE 'INSERT INTO links VALUES ' || v || ';' END AS statement FROM l""",
    "keyword_providers": f"WITH {_keyed_owner()} SELECT doc_id, owner FROM owned WHERE owner IS NOT NULL",
    "keyword_majority": """WITH w AS (SELECT DISTINCT lang || '-' || source AS group_id, doc_id, word FROM (SELECT *, unnest(string_split(text, ' ')) AS word FROM documents) WHERE regexp_matches(word, '^[a-z]+$')),
s AS (SELECT group_id, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1), n AS (SELECT group_id, word, count(*) AS n_docs FROM w GROUP BY 1, 2)
SELECT group_id, (row_number() OVER (PARTITION BY group_id ORDER BY n_docs DESC, word))::INT AS rank, word, n_docs FROM n JOIN s USING (group_id) WHERE n_docs >= 0.5 * docs QUALIFY row_number() OVER (PARTITION BY group_id ORDER BY n_docs DESC, word) <= 10""",
    "species_share": """WITH c AS (SELECT source AS group_id, sum(len(regexp_extract_all(text, 'th')))::BIGINT AS en, sum(len(regexp_extract_all(text, 'sch')))::BIGINT AS de, sum(len(regexp_extract_all(text, 'eau')))::BIGINT AS fr, sum(len(regexp_extract_all(text, 'ción')))::BIGINT AS es FROM documents GROUP BY 1)
SELECT group_id, CASE greatest(en, de, fr, es) WHEN en THEN 'en' WHEN de THEN 'de' WHEN fr THEN 'fr' ELSE 'es' END AS kind, greatest(en, de, fr, es) AS hits, coalesce(round(greatest(en, de, fr, es)::DOUBLE / nullif(en + de + fr + es, 0), 4), 0.0) AS share FROM c""",
    "top_corrections": f"WITH {_LOG} SELECT key, article_id, count(*) AS n FROM log WHERE kind = 'correct' GROUP BY 1, 2 ORDER BY n DESC, key, article_id LIMIT 25",
    "penalty_ranking": f"WITH {_LINES}, {_CHECKED}, f AS (SELECT unnest(errors) AS code FROM checked) SELECT code, count(*) AS n FROM f GROUP BY 1 ORDER BY n DESC, code LIMIT 30",
    "free_text_filter": f"WITH {_ARTICLES} SELECT id, name, family, reference FROM articles WHERE contains(lower(concat_ws(' ', name, family, reference)), 'ring 1')",
    "folder_triage": f"""WITH {_keyed_owner()}, s AS (SELECT source AS folder, CASE WHEN length(trim(text)) = 0 THEN 'empty' WHEN length(text) < 50 THEN 'short' WHEN owner IS NULL THEN 'unknown' ELSE 'known' END AS state FROM owned)
SELECT folder, count(*) AS n, count(*) FILTER (state = 'empty') AS empty, count(*) FILTER (state = 'short') AS short, count(*) FILTER (state = 'unknown') AS unknown, count(*) FILTER (state = 'known') AS known FROM s GROUP BY 1""",
    "file_denylist": """WITH n AS (SELECT page_id, string_split(url, '/')[-1] AS name FROM pages) SELECT page_id, name, NOT regexp_matches(name, '^[0-9]') AND regexp_matches(upper(regexp_extract(name, '[A-Za-z0-9]+')), '^(A|P|T|E)') AS skipped FROM n""",
    "word_rows": "SELECT l_orderkey AS page, floor(l_linenumber * 3.0 / 4.0 + 0.5)::BIGINT AS band, string_agg(l_partkey::VARCHAR, ' ' ORDER BY l_extendedprice, l_partkey::VARCHAR) AS text FROM lineitem GROUP BY 1, 2",
    "sql_dump": "SELECT p_partkey AS id, p_name AS name, 'it''s, ' || p_brand AS brand, NULL::VARCHAR AS nothing, p_size AS size, p_partkey AS again FROM part",
    "retention": f"WITH {_LOG} SELECT event_id, key, kind FROM log WHERE ts < (SELECT max(ts) FROM log) - INTERVAL 20 DAY",
}
ORACLE_SQL["similarity_buckets"] = f"SELECT score, count(*) AS n FROM ({ORACLE_SQL['link_likeness']}) GROUP BY 1"
