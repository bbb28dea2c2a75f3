"""DuckDB SQL of the evidence-matching queries, over the same views."""

from __future__ import annotations

from ..functions import text
from ..operators.boxes import CLASSES, REGIONS
from ..operators import scoring
from ..sources.fixtures import with_views


def _list(words) -> str:
    return ", ".join("'" + w + "'" for w in words)


def _digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '', 'g')"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '^0+', '')"


def _no_zeros(x: str) -> str:
    return f"CASE WHEN {_bare(x)} = '' THEN '0' ELSE {_bare(x)} END"


def _zfill(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) >= {n} THEN {x} ELSE lpad({x}, {n}, '0') END"


def _root(x: str, words) -> str:
    kept = f"list_filter(regexp_split_to_array(trim({x}), '\\s+'), lambda w: w <> '' AND lower(w) NOT IN ({_list(words)}))"
    return f"CASE WHEN len({kept}) > 0 THEN array_to_string({kept}, ' ') ELSE {x} END"


def _catalog_root(x: str) -> str:
    return f"trim(regexp_replace({_root(x, text.CATALOG_SUFFIXES)}, '[^a-zA-Z\\s]', '', 'g'))"


def _clean(x: str) -> str:
    return f"trim(lower(regexp_replace({x}, '[^a-zA-Z0-9\\s]', '', 'g')))"


def _closed_root(x: str) -> str:
    return _clean(_root(x, text.CLOSED_SUFFIXES))


def _ratio(a: str, b: str) -> str:
    """Twice the longest common subsequence over both lengths, by a table folded row by row."""
    table = (
        f"list_reduce(range(1, length({a}) + 1), lambda p, i: list_reduce(range(1, length({b}) + 1), lambda c, j: "
        f"list_append(c, CASE WHEN substr({b}, j, 1) = substr({a}, i, 1) THEN p[j] + 1 ELSE greatest(p[j + 1], c[j]) END), [0::BIGINT]), list_transform(range(0, length({b}) + 1), lambda z: 0::BIGINT))[length({b}) + 1]"
    )
    return f"CAST(CASE WHEN {a} = '' OR {b} = '' THEN 0 WHEN {a} = {b} THEN 100 ELSE round_even(200.0::DOUBLE * {table} / (length({a}) + length({b})), 0) END AS INT)"


def _tokens(x: str) -> str:
    return f"list_sort(list_distinct(list_filter(string_split(regexp_replace(lower({x}), '[^a-z0-9]+', ' ', 'g'), ' '), lambda t: t <> '')))"


PAIRS = """, pairs AS (SELECT DISTINCT lower(s.ocr_name) AS a, lower(c.name) AS b FROM scans s JOIN cards c ON substr(lower(s.ocr_name), 1, 2) = substr(lower(c.name), 1, 2))"""
NUMBER_QUERY = f"""CASE WHEN coalesce(collector_id, '') = '' THEN NULL ELSE ({_no_zeros("trim(split_part(collector_id, '/', 1))")}) END"""
TOTAL_QUERY = "CASE WHEN strpos(collector_id, '/') > 0 AND trim(substr(collector_id, strpos(collector_id, '/') + 1)) <> '' THEN trim(substr(collector_id, strpos(collector_id, '/') + 1)) END"


def _keys(x: str) -> str:
    raw = f"upper(trim(coalesce({x}, '')))"
    d, p, n = _digits(raw), f"regexp_extract({raw}, '^([A-Z]+)[-_ ]*([0-9]+)$', 1)", f"regexp_extract({raw}, '^([A-Z]+)[-_ ]*([0-9]+)$', 2)"
    forms = lambda v: f"{v}, {_no_zeros(v)}, {_zfill(v, 2)}, {_zfill(v, 3)}"
    return (
        f"CASE WHEN {raw} = '' THEN []::VARCHAR[] ELSE list_sort(list_distinct(list_concat([{raw}, {_no_zeros(raw)}], CASE WHEN {d} <> '' THEN [{forms(d)}] ELSE [] END, "
        f"CASE WHEN {p} <> '' THEN list_transform([{forms(n)}], lambda v: {p} || v) ELSE [] END))) END"
    )


def _aliases() -> str:
    d = _digits("number")
    def made(prefixes, *forms):
        return "[" + ", ".join(f"'{p}' || ({f})" for p in prefixes for f in forms) + "]"

    return (
        f"list_sort(list_distinct(CASE WHEN {d} = '' THEN []::VARCHAR[] WHEN set_id = 'svp' THEN {made(['SVP', 'SV-P', 'SV'], d, _zfill(d, 3), _no_zeros(d))} "
        f"WHEN ends_with(set_id, 'tg') THEN {made(['TG'], _zfill(d, 2))} ELSE []::VARCHAR[] END))"
    )


INDEX = f""", keyed AS (SELECT id, unnest(list_distinct(list_concat({_keys("number")}, {_aliases()}))) AS key FROM cards),
asked AS (SELECT scan_id, unnest({_keys("nq")}) AS key FROM (SELECT scan_id, {NUMBER_QUERY} AS nq FROM scans) AS q),
by_number AS (SELECT DISTINCT scan_id, id FROM asked JOIN keyed USING (key))"""

FUZZY = f""", roots AS (SELECT id, lower({_catalog_root("name")}) AS known FROM cards),
known AS (SELECT DISTINCT known FROM roots WHERE known <> ''),
spelled AS (SELECT scan_id, lower({_catalog_root("ocr_name")}) AS root FROM scans WHERE ocr_name IS NOT NULL),
missing AS (SELECT DISTINCT root FROM spelled WHERE root <> '' AND root NOT IN (SELECT known FROM known)),
rated AS (SELECT root, known, {_ratio("root", "known")} AS score FROM missing, known),
fuzzy AS (SELECT root, known, score, place FROM (SELECT *, row_number() OVER (PARTITION BY root ORDER BY score DESC, known DESC) AS place FROM rated WHERE score >= 65) AS r WHERE place <= 8)"""

BY_NAME = """, means AS (SELECT known AS root, known FROM known UNION SELECT root, known FROM fuzzy),
by_name AS (SELECT DISTINCT s.scan_id, r.id FROM spelled s JOIN means m USING (root) JOIN roots r ON r.known = m.known),
found AS (SELECT * FROM by_number UNION SELECT * FROM by_name)"""

SPECIAL = "|".join(scoring.SPECIAL_PREFIXES)


def _token_set(a: str, b: str) -> tuple[str, str]:
    """Columns both, one, two of a pair, and the ratio of those."""
    x, y = _tokens(a), _tokens(b)
    both = f"array_to_string(list_filter({x}, lambda t: list_contains({y}, t)), ' ')"
    rest = lambda p, q: f"array_to_string(list_filter({p}, lambda t: NOT list_contains({q}, t)), ' ')"
    columns = f"{both} AS t0, trim({both} || ' ' || {rest(x, y)}) AS t1, trim({both} || ' ' || {rest(y, x)}) AS t2, len({x}) = 0 OR len({y}) = 0 AS void"
    return columns, f"CASE WHEN void THEN 0 ELSE greatest({_ratio('t0', 't1')}, {_ratio('t0', 't2')}, {_ratio('t1', 't2')}) END"


_SET_COLUMNS, _SET_RATIO = _token_set("a", "b")

EVIDENCE = f""", likes AS (SELECT a, b, greatest({_ratio("a", "b")}, {_SET_RATIO})::DOUBLE AS alike FROM (SELECT a, b, {_SET_COLUMNS} FROM (
  SELECT DISTINCT lower(s.ocr_name) AS a, lower(c.name) AS b FROM found f JOIN scans s USING (scan_id) JOIN cards c USING (id) WHERE s.ocr_name IS NOT NULL) AS p) AS t),
facts AS (SELECT f.scan_id, f.id, c.name, c.hp, c.number, c.printed_total, c.set_id, s.ocr_name, s.ocr_hp, s.collector_id, nq, tq, upper(trim(nq)) AS q, upper(trim(c.number)) AS n, CAST(c.printed_total AS VARCHAR) AS st, {_digits("tq")} AS td,
    coalesce(l.alike, 0) AS name_score, CASE WHEN s.ocr_hp <> 0 AND s.ocr_hp = TRY_CAST(c.hp AS INT) THEN 100.0 ELSE 0.0 END AS hp_score,
    regexp_matches(upper(c.number), '^({SPECIAL})') OR regexp_matches(upper(coalesce(nq, '')), '^({SPECIAL})') OR contains(lower(c.set_name), 'promo') OR c.set_id IN ({_list(scoring.SPECIAL_SETS)}) OR regexp_matches(c.set_id, '(tg|gg|sv)$') AS special
  FROM found f JOIN (SELECT *, {NUMBER_QUERY} AS nq, {TOTAL_QUERY} AS tq FROM scans) s USING (scan_id) JOIN cards c USING (id) LEFT JOIN likes l ON l.a = lower(s.ocr_name) AND l.b = lower(c.name)),
numbered AS (SELECT *, CASE WHEN nq IS NULL THEN 0.0 WHEN n = q OR ({_bare("n")} = {_bare("q")} AND {_bare("n")} <> '') THEN 100.0
    WHEN ((starts_with(q, 'SVP') AND set_id = 'svp') OR (starts_with(q, 'TG') AND ends_with(set_id, 'tg')) OR (starts_with(q, 'SV') AND (ends_with(set_id, 'sv') OR set_id = 'sma'))) AND ({_no_zeros(_digits("q"))}) = ({_no_zeros(_digits("n"))}) THEN 100.0
    WHEN ({_no_zeros(_digits("q"))}) = ({_no_zeros(_digits("n"))}) AND (special OR tq IS NULL) THEN 95.0 WHEN ends_with(n, q) OR ends_with(q, n) THEN 80.0 ELSE 0.0 END AS num_score FROM facts),
totalled AS (SELECT *, CASE WHEN num_score = 100 AND (special OR tq IS NULL) THEN 100.0 WHEN tq IS NOT NULL AND st IS NOT NULL THEN
    CASE WHEN upper(tq) = st OR (td <> '' AND td = st) THEN 100.0 WHEN special THEN 90.0 WHEN td = '' THEN 0.0 WHEN abs(TRY_CAST(td AS BIGINT) - printed_total) <= 2 THEN 60.0
      WHEN length(td) = length(st) AND len(list_filter(range(1, length(st) + 1), lambda i: substr(st, i, 1) <> substr(td, i, 1))) = 1 THEN 50.0 ELSE 0.0 END
    WHEN special THEN 80.0 ELSE 0.0 END AS total_score FROM numbered),
scored AS (SELECT *, round(total_score * 0.30::DOUBLE + num_score * 0.30::DOUBLE + name_score * 0.25::DOUBLE + hp_score * 0.15::DOUBLE, 6) AS final_score,
    CAST(nq IS NOT NULL AND num_score > 0 AND (tq IS NULL OR total_score > 0) AS INT) + CAST(ocr_name IS NOT NULL AND name_score >= 60 AS INT) + CAST(hp_score > 0 AS INT) AS n_evidence,
    num_score = 100 AND total_score >= 90 AND (name_score >= 60 OR hp_score = 100) AS strong, tq IS NOT NULL OR (special AND num_score = 100) AS set_identity FROM totalled),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY final_score DESC, id) AS INT) AS place FROM scored)"""

SCORED = with_views("cards", "scans") + INDEX + FUZZY + BY_NAME + EVIDENCE

SPELLINGS = {"scans": "SELECT DISTINCT ocr_name FROM scans WHERE ocr_name IS NOT NULL", "readings": "SELECT DISTINCT name AS ocr_name FROM readings WHERE name IS NOT NULL"}


def _closed(source: str) -> str:
    return f""", names AS (SELECT name, min(k) AS ord, {_clean("name")} AS key, {_closed_root("name")} AS root FROM cards GROUP BY name),
spellings AS (SELECT ocr_name, {_clean("ocr_name")} AS own, {_closed_root("ocr_name")} AS own_root FROM ({SPELLINGS[source]}) AS s),
exact AS (SELECT s.ocr_name, arg_max(n.name, n.ord) AS match FROM spellings s JOIN names n ON s.own = n.key WHERE s.own <> '' GROUP BY s.ocr_name),
placed AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY ord) AS place FROM names WHERE root <> ''),
undecided AS (SELECT * FROM spellings WHERE own <> '' AND ocr_name NOT IN (SELECT ocr_name FROM exact)),
near_pool AS (SELECT u.ocr_name, p.name, 0 AS kind FROM undecided u JOIN placed p ON u.own_root = p.root
  UNION ALL SELECT u.ocr_name, p.name, 1 FROM undecided u JOIN placed p ON substr(u.own_root, 1, 3) = substr(p.root, 1, 3) AND u.own_root <> p.root WHERE p.place <= 5 AND length(u.own_root) >= 3),
pool AS (SELECT * FROM near_pool UNION ALL SELECT u.ocr_name, n.name, 2 FROM undecided u, names n WHERE u.ocr_name NOT IN (SELECT ocr_name FROM near_pool))"""


CLOSED = _closed("scans")
MATCHED = f""", ab AS (SELECT DISTINCT s.own AS a, n.key AS b FROM pool p JOIN spellings s USING (ocr_name) JOIN names n USING (name)),
sets AS (SELECT a, b, {_SET_RATIO} AS t FROM (SELECT a, b, {_SET_COLUMNS} FROM ab) AS z),
parts AS (SELECT a, b, max({_ratio("sh", "w")}) AS p FROM (SELECT a, b, sh, substr(lo, i, length(sh)) AS w FROM (SELECT a, b, sh, lo, unnest(range(1, length(lo) - length(sh) + 2)) AS i FROM (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM ab) AS o) AS x) AS y GROUP BY a, b),
rated_pairs AS (SELECT a, b, {_ratio("a", "b")} / 100.0::DOUBLE * 0.45::DOUBLE + t / 100.0::DOUBLE * 0.40::DOUBLE + p / 100.0::DOUBLE * 0.15::DOUBLE AS score FROM sets JOIN parts USING (a, b)),
judged_names AS (SELECT p.ocr_name, p.name, round(CASE WHEN s.own_root = n.root AND n.root <> '' THEN greatest(score, 0.85::DOUBLE) ELSE score END, 3) AS score, p.kind, n.ord FROM pool p JOIN spellings s USING (ocr_name) JOIN names n USING (name) JOIN rated_pairs r ON r.a = s.own AND r.b = n.key),
best_names AS (SELECT ocr_name, name AS match, score AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY ocr_name ORDER BY score DESC, kind, ord) AS k FROM judged_names) AS j WHERE k = 1 AND score >= 0.55),
decided AS (SELECT ocr_name, match, 1.0::DOUBLE AS confidence FROM exact UNION ALL SELECT * FROM best_names)"""


def _partial(a: str, b: str) -> str:
    one = _ratio("sh", "substr(lo, i, length(sh))")
    return (
        f"(SELECT CASE WHEN sh = '' THEN 0 ELSE max({one}) END FROM (SELECT sh, lo, unnest(range(1, length(lo) - length(sh) + 2)) AS i FROM "
        f"(SELECT CASE WHEN length({a}) <= length({b}) THEN {a} ELSE {b} END AS sh, CASE WHEN length({a}) <= length({b}) THEN {b} ELSE {a} END AS lo) AS o) AS w GROUP BY sh)"
    )


_CASES = "lap IS NULL OR glare IS NULL OR area IS NULL THEN 'empty' WHEN lap < 70 THEN 'blurry' WHEN ml_blurry > 0.90 AND lap < 140 THEN 'probably blurry' WHEN glare > 0.08 THEN 'glare' WHEN ml_glare > 0.95 AND glare > 0.03 THEN 'probably glare' WHEN area < 0.10 AND NOT card_like THEN 'no card'"
REASON = f"CASE WHEN {_CASES} END"
QUALITY = "floor(100 * (least(lap / 350.0::DOUBLE, 1) * 0.45::DOUBLE + greatest(0, 1 - glare / 0.08::DOUBLE) * 0.30::DOUBLE + CASE WHEN card_like THEN 1 ELSE least(area / 0.45::DOUBLE, 1) END * 0.25::DOUBLE) * 100 + 0.5) / 100.0::DOUBLE"


def _modal(source: str, group: str, value: str, order: str) -> str:
    return (
        f"(SELECT {group}, arg_max(v, (n, -f)) AS mode, max(n) AS n FROM (SELECT {group}, {value} AS v, count(*) AS n, min({order}) AS f FROM {source} WHERE {value} IS NOT NULL GROUP BY ALL) AS c GROUP BY {group})"
    )


BURST = f""", judged AS (SELECT *, {REASON} AS reason, CASE WHEN {REASON} IS NULL THEN {QUALITY} ELSE 0 END AS quality FROM readings),
passed AS (SELECT * FROM judged WHERE reason IS NULL),
spelt AS (SELECT burst_id, name, count(*) AS n, min(frame_no) AS f, regexp_replace(lower(name), '[^a-z]', '', 'g') AS bare FROM passed WHERE name IS NOT NULL GROUP BY burst_id, name),
compared AS (SELECT a.burst_id, a.name, a.f, b.n, a.bare AS x, b.bare AS y FROM spelt a JOIN spelt b USING (burst_id)),
alike AS (SELECT x, y, CASE WHEN x = y AND x <> '' THEN 1.0::DOUBLE ELSE {_ratio("x", "y")} / 100.0::DOUBLE END AS s FROM (SELECT DISTINCT x, y FROM compared) AS d),
means AS (SELECT burst_id, name, f, round(sum(s * n) / sum(n), 9) AS mean, round(sum(CASE WHEN s >= 0.78 THEN n ELSE 0 END) / sum(n), 9) AS agreement, sum(n) AS total FROM compared JOIN alike USING (x, y) GROUP BY ALL),
chosen AS (SELECT burst_id, name, CASE WHEN total = 1 THEN 1.0 ELSE agreement END AS agreement FROM (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY mean DESC, CAST(regexp_matches(name, '(?i)\\s(?:ex|gx|v|vmax|vstar)$') AS INT) DESC, f) AS k FROM means) AS m WHERE k = 1),
sizes AS (SELECT burst_id, count(*) AS n_frames, count(*) FILTER (reason IS NULL) AS n_passed FROM judged GROUP BY burst_id),
bests AS (SELECT burst_id, arg_max(frame_no, (quality, -frame_no)) AS best_frame, count(name) AS n_names FROM passed GROUP BY burst_id),
burst AS (SELECT z.burst_id, n_frames, n_passed, best_frame, c.name, h.mode AS hp, p.mode AS printed_id, round(coalesce(c.agreement, 0) * n_names / n_passed, 6) AS name_agreement,
    round(coalesce(h.n, 0) / n_passed, 9) AS hp_agreement, round(coalesce(p.n, 0) / n_passed, 9) AS id_agreement
  FROM sizes z JOIN bests b USING (burst_id) LEFT JOIN chosen c USING (burst_id) LEFT JOIN {_modal("passed", "burst_id", "hp", "frame_no")} h USING (burst_id) LEFT JOIN {_modal("passed", "burst_id", "printed_id", "frame_no")} p USING (burst_id) WHERE n_passed > 0)"""

_MISREAD = " ".join(f"WHEN total = '{bad}' THEN '{good}'" for bad, good in text.MISREAD_TOTALS.items())
_TRY = "list_filter(list_transform(list_filter(range(1, length(total) + 1), lambda i: substr(total, i, 1) IN ('0', '5', '6', '9')), lambda i: substr(total, 1, i - 1) || '8' || substr(total, i + 1)), lambda t: t IN (" + _list(text.TOTAL_TARGETS) + "))[1]"
_LETTERS = "list_transform(range(1, length(txt) + 1), lambda i: substr(txt, i, 1))"


def _restricted(field: str) -> str:
    fix = f"translate(c, '{text.DIGIT_FROM}', '{text.DIGIT_TO}')"
    return f"array_to_string(list_transform(list_filter({_LETTERS}, lambda c: contains('{text.ALPHABETS[field]}', {fix}) OR contains('{text.ALPHABETS[field]}', c)), lambda c: {fix}), '')"


_TOKEN = r"""trim(regexp_replace(regexp_replace(CASE WHEN regexp_matches({s}, '[eE3@][xX]$') THEN regexp_replace({s}, '^(.*?)(?:[@\*\s]?[eE3@][xX])$', '\1 ex') ELSE {s} END, '([a-z])[A-Z]$', '\1'), '[^a-zA-Z\s''-]', '', 'g'))"""


def _token(x: str) -> str:
    return _TOKEN.replace("{s}", f"regexp_replace(trim({x}), '[^a-zA-Z0-9]+$', '')")


_GOOD = lambda low: f"lambda v: v BETWEEN {low} AND 400 AND v % 10 = 0"
_INTS = lambda pattern: f"list_transform(regexp_extract_all(txt, '{pattern}', 1), lambda s: TRY_CAST(s AS INT))"
_NUMBERS = "regexp_extract_all(txt, '([0-9]+)', 1)"
_WINDOWS = f"flatten(list_transform({_NUMBERS}, lambda s: list_transform(range(1, length(s) - 1), lambda i: TRY_CAST(substr(s, i, 3) AS INT))))"


def _two(x: str, places: int = 2) -> str:
    """Rounded half up, by the same arithmetic as the operators'."""
    return f"floor({x} * {10**places} + 0.5) / {10**places}.0::DOUBLE"


VERIFIED = "coalesce(strong OR (set_identity AND final_score >= 58 AND n_evidence >= 2), false)"


def _chain(cards: str) -> str:
    """The fallback searches; ``found`` are the scans with local candidates, ``cards`` what is searched."""
    return f""", want AS (SELECT scan_id, lower({_catalog_root("coalesce(ocr_name, '')")}) AS root, {NUMBER_QUERY} AS nq FROM scans WHERE scan_id NOT IN (SELECT scan_id FROM found)),
tries AS (SELECT scan_id, root, nq, unnest([1, 2, 3, 4, 5, 6]) AS step FROM want),
asked_for AS (SELECT scan_id, step, CASE step WHEN 1 THEN 'name' WHEN 5 THEN 'number' WHEN 6 THEN 'number' ELSE 'start' END AS kind,
  CASE step WHEN 1 THEN root WHEN 2 THEN root WHEN 3 THEN substr(root, 1, 4) WHEN 4 THEN substr(root, 1, 3) WHEN 5 THEN nq ELSE {_no_zeros(_digits("nq"))} END AS key
  FROM tries WHERE CASE step WHEN 1 THEN root <> '' WHEN 2 THEN root <> '' WHEN 3 THEN length(root) >= 4 WHEN 4 THEN length(root) >= 3 ELSE nq IS NOT NULL END),
finds AS (SELECT scan_id, step, kind, key FROM asked_for a WHERE EXISTS (SELECT 1 FROM {cards} c WHERE (kind = 'name' AND lower(c.name) = key) OR (kind = 'start' AND starts_with(lower(c.name), key)) OR (kind = 'number' AND c.number = key))),
chain AS (SELECT DISTINCT scan_id, 0 AS step, 'local' AS kind, NULL AS key FROM found UNION ALL SELECT scan_id, step, kind, key FROM (SELECT *, min(step) OVER (PARTITION BY scan_id) AS least FROM finds) AS f WHERE step = least)"""


CHAIN = _chain("cards")
SUBSET_CHAIN = (", some_cards AS (SELECT * FROM cards WHERE k % 3 = 0)" + (INDEX + FUZZY + BY_NAME).replace("FROM cards", "FROM some_cards")) + _chain("some_cards")

_UNIQUE = lambda n, t: f"coalesce({n} || '/' || CAST({t} AS VARCHAR), {n})"
VISUAL = f""", eyes AS (SELECT s.scan_id, c.id, CAST(s.scan_id % 25 + 75 AS DOUBLE) / 100 AS similarity, c.name, c.hp, c.number, c.printed_total, s.ocr_name, s.ocr_hp, s.collector_id, s.scan_id IN (SELECT scan_id FROM found) AS known
  FROM scans s, (SELECT count(*) AS n FROM cards) AS z JOIN cards c ON c.k = (s.scan_id * 7 + s.scan_id % 4) % z.n),
eye_pairs AS (SELECT DISTINCT lower(name) AS a, lower(ocr_name) AS b FROM eyes WHERE ocr_name IS NOT NULL),
eye_part AS (SELECT a, b, max({_ratio("sh", "w")}) AS p FROM (SELECT a, b, sh, substr(lo, i, length(sh)) AS w FROM (SELECT a, b, sh, lo, unnest(range(1, length(lo) - length(sh) + 2)) AS i FROM (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM eye_pairs) AS o) AS x) AS y GROUP BY a, b),
eye_alike AS (SELECT a, b, p, {_ratio("a", "b")} AS r FROM eye_part),
eye_tests AS (SELECT e.*, p, r, known AND similarity >= 0.80 AND (coalesce(ocr_hp <> 0 AND TRY_CAST(hp AS INT) <> 0 AND abs(TRY_CAST(hp AS INT) - ocr_hp) > 30, false) OR coalesce(p < 40, false)) AS disagrees
  FROM eyes e LEFT JOIN eye_alike l ON l.a = lower(e.name) AND l.b = lower(e.ocr_name)),
gated AS (SELECT *, known AND similarity >= 0.88 AND NOT disagrees AND (coalesce(r >= 75, false) OR coalesce(ocr_hp <> 0 AND ocr_hp = TRY_CAST(hp AS INT), false) OR coalesce({_UNIQUE("number", "printed_total")} = collector_id, false)) AS accepted FROM eye_tests)"""

_PRICE = "coalesce(nullif({0}.holofoil, 0), nullif({0}.normal, 0), nullif({0}.reverse_holofoil, 0), {0}.first_edition)"
_PADDED = f"CASE WHEN length(w) >= 3 AND length(b.number) < length(w) AND regexp_matches(b.number, '^[0-9]+$') THEN lpad(b.number, CAST(length(w) AS INT), '0') ELSE b.number END"
RESPONSES = f""", best AS (SELECT s.scan_id, r.id, r.final_score, {VERIFIED} AS ok, coalesce({_digits("trim(split_part(s.collector_id, '/', 1))")}, '') AS w FROM scans s LEFT JOIN ranked r ON r.scan_id = s.scan_id AND r.place = 1),
firsts AS (SELECT scan_id, count(*) AS n, arg_min({_UNIQUE("number", "printed_total")}, place) AS first_id, arg_min({_two("least(final_score / 100, 1)")}, place) AS first_confidence FROM ranked WHERE place <= 5 GROUP BY scan_id),
chosen_by AS (SELECT x.*, g.similarity, g.disagrees, coalesce(g.accepted, false) AS eye, NOT coalesce(g.accepted, false) AND ok AS rank_ok, g.id AS eye_id FROM best x LEFT JOIN gated g USING (scan_id))
SELECT x.scan_id, eye OR rank_ok AS verified, CASE WHEN eye THEN {_two("similarity")} WHEN rank_ok THEN {_two("least(final_score / 100, 1)")} ELSE 0 END AS confidence,
  CASE WHEN eye THEN {_two("similarity * 100", 1)} ELSE {_two("coalesce(final_score, 0)", 1)} END AS best_score,
  CASE WHEN eye THEN v.name WHEN rank_ok THEN b.name END AS name, TRY_CAST(CASE WHEN eye THEN v.hp WHEN rank_ok THEN b.hp END AS INT) AS hp,
  CASE WHEN eye THEN {_UNIQUE("v.number", "v.printed_total")} WHEN rank_ok THEN ({_PADDED}) || coalesce('/' || CAST(b.printed_total AS VARCHAR), '') END AS unique_id,
  CASE WHEN eye THEN v.set_name WHEN rank_ok THEN b.set_name END AS set_name, CASE WHEN eye THEN v.set_series WHEN rank_ok THEN b.set_series END AS set_series,
  CASE WHEN eye THEN v.rarity WHEN rank_ok THEN b.rarity ELSE 'Unknown' END AS rarity, CASE WHEN eye THEN {_PRICE.format("v")} WHEN rank_ok THEN {_PRICE.format("b")} END AS market_price,
  eye AS visual_match_applied, CASE WHEN eye THEN {_two("similarity", 4)} END AS visual_similarity, CASE WHEN NOT eye AND f.n > 0 THEN v.name END AS seen_name, CASE WHEN NOT eye AND f.n > 0 THEN TRY_CAST(v.hp AS INT) END AS seen_hp, CASE WHEN NOT eye AND f.n > 0 THEN {_two("similarity", 4)} END AS seen_similarity,
  disagrees AND NOT eye AS disagreement, CAST(coalesce(f.n, 0) AS INT) AS n_candidates, f.first_id, f.first_confidence,
  CASE WHEN eye OR rank_ok THEN NULL WHEN f.n IS NULL THEN 'No cards found.' ELSE 'No confident match found.' END AS message
FROM chosen_by x LEFT JOIN cards b ON b.id = x.id LEFT JOIN cards v ON v.id = x.eye_id LEFT JOIN firsts f ON f.scan_id = x.scan_id"""

_MEANS = lambda x: "CASE upper(" + x + ") " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.PREFIX_MEANS.items()) + f" ELSE upper({x}) END"
_SLOT = lambda x: f"translate({x}, '{text.SLOT_FROM}', '{text.SLOT_TO}')"
_WHOLE = lambda x: f"regexp_matches({x}, '^[0-9]+$')"


def _matches(source: str, column: str, pattern: str, groups: str) -> str:
    """A row for each match of a pattern, with its groups a, b, c, d, in order."""
    lists = ", ".join(f"regexp_extract_all({column}, '{pattern}', {g}) AS l{g}" for g in range(1, len(groups) + 1))
    return f"(SELECT *, {', '.join(f'l{g}[m] AS {c}' for g, c in enumerate(groups, 1))} FROM (SELECT *, unnest(range(1, len(l1) + 1)) AS m FROM (SELECT *, {lists} FROM {source}) AS x) AS y)"


_FORM = "'(?i)^[0-9]{1,4}[a-z]?$'"
PRINTED = f""", lined AS (SELECT event_id, list_filter(list_transform(string_split(txt, chr(10)), lambda s: trim(s)), lambda s: s <> '') AS ls FROM id_texts),
chunked AS (SELECT event_id, list_concat(ls, CASE WHEN len(ls) > 1 THEN list_concat(list_transform(range(1, len(ls)), lambda i: ls[i] || ' ' || ls[i + 1]), [array_to_string(ls, ' ')]) ELSE []::VARCHAR[] END) AS cs FROM lined),
pieces AS (SELECT event_id, ci, cs[ci] AS c FROM (SELECT *, unnest(range(1, len(cs) + 1)) AS ci FROM chunked) AS x),
promo AS (SELECT event_id, ci, m, {_MEANS("a")} AS p, {_SLOT("b")} AS n FROM {_matches("pieces", "c", text.PROMO, "ab")} AS x),
subset AS (SELECT event_id, ci, m, {_MEANS("a")} AS p, {_SLOT("b")} AS n, {_MEANS("c_")} AS q, {_SLOT("d")} AS t FROM (SELECT event_id, ci, m, a, b, c_, d FROM (SELECT * RENAME (c AS piece) FROM pieces) AS z, LATERAL (SELECT unnest(range(1, len(l1) + 1)) AS m, l1, l2, l3, l4 FROM (SELECT regexp_extract_all(piece, '{text.SUBSET}', 1) AS l1, regexp_extract_all(piece, '{text.SUBSET}', 2) AS l2, regexp_extract_all(piece, '{text.SUBSET}', 3) AS l3, regexp_extract_all(piece, '{text.SUBSET}', 4) AS l4) AS u) AS w, LATERAL (SELECT l1[m] AS a, l2[m] AS b, l3[m] AS c_, l4[m] AS d) AS g) AS x),
fraction AS (SELECT event_id, ci, m, n, CASE WHEN t IN ('055', '056') THEN '086' ELSE t END AS t FROM (SELECT event_id, ci, m, {_SLOT("a")} AS n, {_SLOT("b")} AS t FROM {_matches("pieces", "c", text.FRACTION, "ab")} AS x) AS y),
found_ids AS (
  SELECT event_id, ci, 1 AS g, m, p || CASE WHEN p IN ('SWSH', 'SVP') AND length(n) <= 2 THEN lpad(n, 3, '0') WHEN p IN ('XY', 'SM', 'BW', 'DP', 'HGSS') AND length(n) = 1 THEN lpad(n, 2, '0') ELSE n END AS id, 0.98::DOUBLE AS confidence, 'promo_prefix' AS pattern FROM promo WHERE {_WHOLE("n")} AND n <> '0'
  UNION ALL SELECT event_id, ci, 2, m, p || n || '/' || q || t, 0.96, 'subset_fraction' FROM subset WHERE {_WHOLE("n")} AND {_WHOLE("t")} AND TRY_CAST(n AS INT) BETWEEN 1 AND 999 AND TRY_CAST(t AS INT) BETWEEN 10 AND 999
  UNION ALL SELECT event_id, ci, 3, m, upper(n) || '/' || upper(t), 0.95, 'standard_fraction' FROM fraction WHERE regexp_matches(n, {_FORM}) AND regexp_matches(t, {_FORM}) AND TRY_CAST({_digits("n")} AS INT) BETWEEN 1 AND 999 AND TRY_CAST({_digits("t")} AS INT) BETWEEN 10 AND 999
  UNION ALL SELECT event_id, ci, 4, m, upper(a), 0.88, 'suffix_id' FROM {_matches("pieces", "c", text.SUFFIX, "a")} AS x),
printed AS (SELECT event_id, id, confidence, pattern FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY confidence DESC, ci, g, m) AS k FROM found_ids) AS f WHERE k = 1)"""


def _half(x: str) -> str:
    """A fraction's half with misread digits corrected, unless its prefix explains them."""
    starts = lambda *p: "(" + " OR ".join(f"starts_with({x}, '{q}')" for q in p) + ")"
    s5 = f"CASE WHEN {starts('SWSH', 'SV', 'SM')} THEN {x} ELSE translate({x}, 'sS', '55') END"
    b8 = f"CASE WHEN {starts('BW')} THEN {s5} ELSE replace({s5}, 'B', '8') END"
    o0 = f"CASE WHEN {starts('PROMO', 'TG', 'GG')} THEN {b8} ELSE translate({b8}, 'Oo', '00') END"
    return f"CASE WHEN {starts('TG', 'GG', 'RC', 'SV', 'SWSH', 'SVP')} THEN {o0} ELSE translate({o0}, 'Il|', '111') END"


COLLECTOR = rf""", slashed AS (SELECT event_id, CASE WHEN contains(txt, '/') THEN txt ELSE regexp_replace(txt, '{text.MISSING_SLASH}', '\1/\2', 'g') END AS c FROM id_texts),
totals AS (SELECT DISTINCT CAST(printed_total AS VARCHAR) AS t FROM cards UNION SELECT unnest([{_list(text.KNOWN_TOTALS)}])),
halves AS (SELECT event_id, m, {_half("a")} AS n, {_half("b")} AS total FROM {_matches("slashed", "c", text.FALLBACK_FRACTION, "ab")} AS x),
whole_halves AS (SELECT event_id, m, CASE WHEN regexp_matches(n, '^4[0-9][0-9]$') THEN '1' || substr(n, 2) ELSE n END AS n, CASE WHEN total IN (SELECT t FROM totals) THEN total {_MISREAD} ELSE coalesce({_TRY}, total) END AS total FROM halves
  WHERE {_WHOLE("n")} AND {_WHOLE("total")} AND TRY_CAST(n AS INT) BETWEEN 1 AND 999 AND TRY_CAST(total AS INT) BETWEEN 10 AND 999),
guesses AS (
  SELECT event_id, 1 AS g, m, upper(a) || b || '/' || upper(c_) AS id, 90 AS score FROM (SELECT event_id, m, l1[m] AS a, l2[m] AS b, l3[m] AS c_ FROM (SELECT *, unnest(range(1, len(l1) + 1)) AS m FROM (SELECT *, regexp_extract_all(c, '{text.FALLBACK_SUBSET}', 1) AS l1, regexp_extract_all(c, '{text.FALLBACK_SUBSET}', 2) AS l2, regexp_extract_all(c, '{text.FALLBACK_SUBSET}', 3) AS l3 FROM slashed) AS x) AS y) AS z
  UNION ALL SELECT event_id, 2, m, upper(a) || b, 95 FROM {_matches("slashed", "c", text.FALLBACK_PROMO, "ab")} AS x
  UNION ALL SELECT event_id, 3, m, n || '/' || total, CASE WHEN CAST(total AS INT) BETWEEN 20 AND 800 THEN 40 ELSE 0 END + CASE WHEN CAST(n AS INT) BETWEEN 1 AND 999 THEN 20 ELSE 0 END + CASE WHEN CAST(n AS INT) > CAST(total AS INT) AND CAST(total AS INT) >= 30 THEN 25 ELSE 0 END + CASE WHEN total IN (SELECT t FROM totals) THEN 20 ELSE 0 END FROM whole_halves),
fallback AS (SELECT event_id, id FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY score DESC, g, m) AS k FROM guesses) AS f WHERE k = 1)"""


_BURST_OK = f"{_two('least(x.final_score / 100, 1)')}"
BURST_ANSWERS = (
    with_views("cards", "readings")
    + BURST.replace("means", "burst_means")
    + ", scans AS (SELECT burst_id AS scan_id, printed_id AS collector_id, name AS ocr_name, hp AS ocr_hp FROM burst)"
    + INDEX
    + FUZZY
    + BY_NAME
    + EVIDENCE
    + f""", best AS (SELECT s.scan_id, r.id, r.final_score, {VERIFIED} AS ok, coalesce({_digits("trim(split_part(s.collector_id, '/', 1))")}, '') AS w FROM scans s LEFT JOIN ranked r ON r.scan_id = s.scan_id AND r.place = 1),
firsts AS (SELECT scan_id, count(*) AS n FROM ranked WHERE place <= 5 GROUP BY scan_id),
answered AS (SELECT z.*, ok, x.final_score, CASE WHEN ok THEN {_BURST_OK} ELSE 0.0::DOUBLE END AS sure, b.name AS card_name, TRY_CAST(b.hp AS INT) AS card_hp, b.set_name, b.rarity, ({_PADDED}) || coalesce('/' || CAST(b.printed_total AS VARCHAR), '') AS card_id, coalesce(f.n, 0) AS n
  FROM burst z JOIN best x ON x.scan_id = z.burst_id LEFT JOIN cards b ON b.id = x.id LEFT JOIN firsts f ON f.scan_id = z.burst_id),
lost AS (SELECT * FROM judged WHERE burst_id NOT IN (SELECT burst_id FROM passed))
SELECT burst_id, true AS success, ok AS verified, sure AS confidence, floor(100 * (0.15::DOUBLE * n_passed / n_frames + 0.30::DOUBLE * id_agreement + 0.15::DOUBLE * name_agreement + 0.10::DOUBLE * hp_agreement + 0.30::DOUBLE * sure) * 100 + 0.5) / 100.0::DOUBLE AS capture_confidence,
  n_frames AS total_frames, n_passed AS passed_frames, NULL AS rejection_reason, coalesce(CASE WHEN ok THEN card_name END, name) AS name, coalesce(CASE WHEN ok THEN card_hp END, hp) AS hp, coalesce(CASE WHEN ok THEN card_id END, printed_id) AS unique_id,
  CASE WHEN ok THEN set_name END AS set_name, CASE WHEN ok THEN coalesce(rarity, 'Unknown') ELSE 'Unknown' END AS rarity, {_two('coalesce(final_score, 0)', 1)} AS best_score,
  {_two('name_agreement')} AS name_agreement, {_two('hp_agreement')} AS hp_agreement, {_two('id_agreement')} AS id_agreement, CASE WHEN ok THEN NULL WHEN n = 0 THEN 'No cards found.' ELSE 'No confident match found.' END AS message, CAST(n AS INT) AS n_candidates FROM answered
UNION ALL SELECT m.burst_id, false, false, 0, 0, z.n_frames, 0, m.mode, NULL, NULL, NULL, NULL, 'Unknown', 0, 0, 0, 0, m.mode, 0 FROM {_modal("lost", "burst_id", "reason", "frame_no")} m JOIN sizes z USING (burst_id)"""
)


ORACLES: dict[str, str] = {
    "q01_catalog_compact": with_views("cards") + ", sets AS (SELECT set_id, min(set_name) AS n, min(set_series) AS s, max(printed_total) AS t FROM cards GROUP BY set_id) SELECT id, name, hp, number, rarity, set_id, CASE k % 4 WHEN 0 THEN n WHEN 1 THEN 'own ' || set_name ELSE set_name END AS set_name, CASE k % 4 WHEN 0 THEN s ELSE set_series END AS set_series, CASE k % 4 WHEN 0 THEN t ELSE printed_total END AS printed_total FROM cards LEFT JOIN sets USING (set_id)",
    "q02_number_keys": with_views("cards") + f" SELECT id, array_to_string({_keys('number')}, ',') AS keys, array_to_string({_aliases()}, ',') AS aliases FROM cards",
    "q03_number_candidates": with_views("cards", "scans") + INDEX + " SELECT scan_id, id FROM by_number",
    "q04_root_name": with_views("cards") + f" SELECT id, {_catalog_root('name')} AS catalog_root, {_closed_root('name')} AS closed_root FROM cards",
    "q05_clean_key": with_views("scans") + f" SELECT scan_id, {_clean('ocr_name')} AS key FROM scans",
    "q06_exact_name": with_views("cards", "scans") + CLOSED + " SELECT s.scan_id, e.match FROM scans s LEFT JOIN exact e USING (ocr_name) WHERE s.ocr_name IS NOT NULL",
    "q07_fuzzy_top8": with_views("cards", "scans") + FUZZY + " SELECT root, known, score, CAST(place AS INT) AS place FROM fuzzy",
    "q08_prefix_block": with_views("cards", "scans") + CLOSED + " SELECT ocr_name, name, kind FROM near_pool UNION ALL SELECT ocr_name, NULL, 2 FROM undecided WHERE ocr_name NOT IN (SELECT ocr_name FROM near_pool)",
    "q09_indel_ratio": with_views("cards", "scans") + PAIRS + f" SELECT a, b, {_ratio('a', 'b')} AS ratio FROM pairs",
    "q10_token_set_ratio": with_views("cards", "scans") + PAIRS + f" SELECT a, b, {_SET_RATIO} AS ratio FROM (SELECT a, b, {_SET_COLUMNS} FROM pairs) AS t",
    "q11_partial_ratio": with_views("cards", "scans") + PAIRS + f" SELECT a, b, max({_ratio('sh', 'w')}) AS ratio FROM (SELECT a, b, sh, substr(lo, i, length(sh)) AS w FROM (SELECT a, b, sh, lo, unnest(range(1, length(lo) - length(sh) + 2)) AS i FROM (SELECT a, b, CASE WHEN length(a) <= length(b) THEN a ELSE b END AS sh, CASE WHEN length(a) <= length(b) THEN b ELSE a END AS lo FROM pairs) AS o) AS x) AS y GROUP BY a, b",
    "q12_closed_set_match": with_views("cards", "scans") + CLOSED + MATCHED + " SELECT s.ocr_name, d.match, coalesce(d.confidence, 0) AS confidence FROM spellings s LEFT JOIN decided d USING (ocr_name)",
    "q13_resolve_candidates": with_views("cards", "readings") + _closed("readings") + MATCHED + " SELECT burst_id, arg_max(match, (confidence, -frame_no)) AS match, max(confidence) AS confidence FROM readings r JOIN decided d ON r.name = d.ocr_name GROUP BY burst_id",
    "q14_parse_printed_id": with_views("id_texts") + PRINTED + " SELECT event_id, id, CASE WHEN id IS NULL THEN 0 ELSE confidence END AS confidence, CASE WHEN txt = '' THEN 'empty_text' WHEN id IS NULL THEN 'no_match' ELSE pattern END AS pattern FROM id_texts LEFT JOIN printed USING (event_id)",
    "q16_parse_collector_id": with_views("cards", "id_texts") + PRINTED + COLLECTOR + " SELECT t.event_id, coalesce(p.id, f.id) AS id FROM id_texts t LEFT JOIN printed p USING (event_id) LEFT JOIN fallback f USING (event_id)",
    "q15_parse_hp": with_views("id_texts") + f" SELECT event_id, coalesce(list_filter({_INTS(chr(40) + '?i)([0-9]{2,3})' + chr(92) + 's*HP' + chr(92) + 'b')}, {_GOOD(30)})[1], list_filter({_INTS(chr(40) + '?i)' + chr(92) + 'bHP' + chr(92) + 's*([0-9]{2,3})')}, {_GOOD(30)})[1], list_filter({_WINDOWS}, {_GOOD(100)})[1], list_filter({_INTS('([0-9]+)')}, {_GOOD(30)})[1]) AS hp FROM id_texts",
    "q17_correct_set_total": with_views("cards", "votes") + f" SELECT session, seq, CASE WHEN total IN ({_list(text.KNOWN_TOTALS)}) OR total IN (SELECT CAST(printed_total AS VARCHAR) FROM cards) THEN total {_MISREAD} ELSE coalesce({_TRY}, total) END AS total FROM (SELECT session, seq, lpad(CAST((session * 7 + seq) % 300 AS VARCHAR), 3, '0') AS total FROM votes) AS t",
    "q18_fix_slash": with_views("id_texts") + r" SELECT event_id, CASE WHEN contains(txt, '/') THEN txt ELSE regexp_replace(txt, '\b([A-Za-z0-9]{2,5})[7l1I|](\d{2,4})\b', '\1/\2', 'g') END AS fixed FROM id_texts",
    "q19_restricted_alphabet": with_views("id_texts") + f" SELECT event_id, {_restricted('hp')} AS hp, {_restricted('collector_id')} AS collector_id FROM id_texts",
    "q20_token_normalize": with_views("scans") + f""" SELECT scan_id, CASE WHEN ocr_name IS NULL THEN NULL ELSE {_token("(ocr_name || '@x!')")} END AS token,
  length(t) >= 2 AND len(list_distinct(string_split(lower(t), ''))) > 1 AND regexp_matches(t, '(?i)[aeiouy]') AND (lower(trim(t)) NOT IN ({_list(text.LAYOUT_WORDS)}) OR lower(trim(t)) IN ({_list(text.NAME_SUFFIXES)})) AS plausible FROM (SELECT *, {_token("ocr_name")} AS t FROM scans) AS s""",
    "q22_roi_vote": with_views("readings") + """, weighed AS (SELECT burst_id, frame_no, printed_id, roi, 0.95::DOUBLE + CASE WHEN contains(roi, 'surgical') THEN 0.10::DOUBLE ELSE 0 END + CASE WHEN starts_with(printed_id, 'SVP') THEN CASE WHEN contains(roi, 'left') THEN 0.15::DOUBLE ELSE 0 END WHEN contains(roi, 'left') THEN 0.15::DOUBLE WHEN contains(roi, 'right') THEN -0.10::DOUBLE ELSE 0 END AS w FROM readings WHERE printed_id IS NOT NULL),
sums AS (SELECT burst_id, printed_id, round(sum(w), 6) AS score, arg_min(roi, frame_no) AS roi, min(frame_no) AS f FROM weighed GROUP BY ALL)
SELECT burst_id, printed_id, score, roi FROM (SELECT *, row_number() OVER (PARTITION BY burst_id ORDER BY score DESC, f) AS k FROM sums) AS s WHERE k = 1""".replace("GROUP BY ALL", "GROUP BY burst_id, printed_id"),
    "q23_modal_value": with_views("readings") + f" SELECT burst_id, mode, n FROM {_modal('readings', 'burst_id', 'printed_id', 'frame_no')} AS m",
    "q25_quality_gate": with_views("frames") + f" SELECT burst_id, frame_no, {REASON} AS reason FROM frames",
    "q26_quality_score": with_views("frames") + f" SELECT burst_id, frame_no, {QUALITY} AS quality FROM frames WHERE {REASON} IS NULL",
    "q27_burst_consensus": with_views("readings") + BURST + " SELECT * FROM burst",
    "q28_capture_confidence": with_views("readings") + BURST + " SELECT burst_id, floor(100 * (0.15::DOUBLE * n_passed / n_frames + 0.30::DOUBLE * id_agreement + 0.15::DOUBLE * name_agreement + 0.10::DOUBLE * hp_agreement + 0.30::DOUBLE * CASE WHEN hp IS NULL THEN 0 ELSE CASE WHEN hp / 400.0 > 1 THEN hp / 40000.0::DOUBLE ELSE hp / 400.0::DOUBLE END END) * 100 + 0.5) / 100.0::DOUBLE AS confidence FROM burst",
    "q29_evidence_scores": SCORED + " SELECT scan_id, id, total_score::DOUBLE AS total_score, num_score::DOUBLE AS num_score, name_score, hp_score::DOUBLE AS hp_score, final_score, n_evidence, strong, set_identity FROM scored",
    "q30_verify_decision": SCORED + f" SELECT scan_id, CASE WHEN ok THEN id END AS id, id AS best_id, {_two('coalesce(final_score, 0)', 1)} AS best_score, coalesce(n_evidence, 0) AS n_evidence, ok AS verified, CASE WHEN ok THEN {_two('least(final_score / 100, 1)')} ELSE 0 END AS confidence FROM (SELECT s.scan_id, r.id, final_score, n_evidence, {VERIFIED} AS ok FROM scans s LEFT JOIN ranked r ON r.scan_id = s.scan_id AND r.place = 1) AS j",
    "q31_top5_candidates": SCORED + f" SELECT scan_id, place, id, coalesce(number || '/' || st, number) AS unique_id, TRY_CAST(hp AS INT) AS hp, {_two('least(final_score / 100, 1)')} AS confidence FROM ranked WHERE place <= 5",
    "q32_vector_topk": "SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 50 = 0) AS s) AS r WHERE rank <= 5",
    "q34_rejection_mode": with_views("frames") + f", judged AS (SELECT *, {REASON} AS reason FROM frames), lost AS (SELECT * FROM judged WHERE burst_id NOT IN (SELECT burst_id FROM judged WHERE reason IS NULL)) SELECT burst_id, mode AS reason, n FROM {_modal('lost', 'burst_id', 'reason', 'frame_no')} AS m",
    "q35_multi_frame_vote": with_views("votes") + """, admitted AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY seq) AS r FROM votes WHERE printed_id IS NOT NULL AND frame_quality >= 50),
held AS (SELECT a.session, a.seq, b.printed_id, count(*) AS n, min(b.r) AS f, avg(b.confidence::DOUBLE) AS mean FROM admitted a JOIN admitted b ON a.session = b.session AND b.r BETWEEN a.r - 9 AND a.r GROUP BY a.session, a.seq, b.printed_id),
best AS (SELECT *, row_number() OVER (PARTITION BY session, seq ORDER BY n DESC, f) AS k FROM held)
SELECT session, seq, CASE WHEN n >= 2 THEN printed_id END AS printed_id, CASE WHEN n >= 3 THEN round(mean, 6) WHEN n = 2 THEN 0.5 ELSE 0 END AS confidence, CASE WHEN n >= 3 THEN 'accepted' WHEN n = 2 THEN 'ambiguous' ELSE 'rejected' END AS status FROM best WHERE k = 1""",
    "q36_price_chain": with_views("cards") + " SELECT id, coalesce(nullif(holofoil, 0), nullif(normal, 0), nullif(reverse_holofoil, 0), first_edition) AS price FROM cards",
    "q37_id_format": SCORED + f""" SELECT scan_id, CASE WHEN length(w) >= 3 AND length(number) < length(w) AND regexp_matches(number, '^[0-9]+$') THEN lpad(number, CAST(length(w) AS INT), '0') ELSE number END || coalesce('/' || st, '') AS unique_id
FROM (SELECT *, coalesce({_digits("trim(split_part(collector_id, '/', 1))")}, '') AS w FROM ranked WHERE place = 1) AS r""",
    "q38_known_totals": with_views("cards") + f" SELECT CAST(printed_total AS VARCHAR) AS total FROM cards UNION SELECT unnest([{_list(text.KNOWN_TOTALS)}])",
    "q39_fallback_chain": SCORED + CHAIN + " SELECT scan_id, step, kind, key FROM chain",
    "q40_bbox_best_per_class": f"""WITH b AS (SELECT l_orderkey AS image, l_partkey * 100000 + l_suppkey * 10 + l_linenumber AS ord, CASE l_returnflag WHEN 'A' THEN 'card' WHEN 'N' THEN 'header_region' ELSE 'stray' END AS label, l_suppkey * 3 - 20 AS x1, l_linenumber * 30 - 40 AS y1, l_suppkey * 9 + 40 AS x2, l_linenumber * 150 AS y2, l_quantity / 50 AS c FROM lineitem),
k AS (SELECT *, floor(c * 10000 + 0.5) / 10000.0::DOUBLE AS confidence FROM b WHERE c >= 0.6 AND label IN ({_list(CLASSES)})),
n AS (SELECT *, row_number() OVER (PARTITION BY image, label ORDER BY confidence DESC, ord) AS n FROM k),
cut AS (SELECT *, greatest(0, least(x1, 629)) AS a1, greatest(0, least(y1, 879)) AS b1, greatest(0, least(x2, 630)) AS a2, greatest(0, least(y2, 880)) AS b2 FROM n WHERE n = 1)
SELECT image, label, confidence, CAST(greatest(0, x2 - x1) AS INT) AS width, CAST(greatest(0, y2 - y1) AS INT) AS height,
  CAST(CASE WHEN a2 > a1 AND b2 > b1 THEN a1 END AS INT) AS x1, CAST(CASE WHEN a2 > a1 AND b2 > b1 THEN b1 END AS INT) AS y1, CAST(CASE WHEN a2 > a1 AND b2 > b1 THEN a2 END AS INT) AS x2, CAST(CASE WHEN a2 > a1 AND b2 > b1 THEN b2 END AS INT) AS y2 FROM cut""",
    "q43_crop_regions": "WITH sizes AS (SELECT p_partkey, p_size * 17 + 100 AS h, p_size * 11 + 90 AS w FROM part), r(name, a, b, c, d) AS (VALUES "
    + ", ".join(f"('{n}', {a}::DOUBLE, {b}::DOUBLE, {c}::DOUBLE, {d}::DOUBLE)" for n, (a, b, c, d) in REGIONS.items())
    + ") SELECT p_partkey, name, CAST(floor(h * a) AS INT) AS y1, CAST(floor(h * b) AS INT) AS y2, CAST(floor(w * c) AS INT) AS x1, CAST(floor(w * d) AS INT) AS x2 FROM sizes, r",
    "q33_visual_gate": SCORED + VISUAL + " SELECT scan_id, id, similarity, disagrees, accepted FROM gated",
    "q44_responses": SCORED + VISUAL + RESPONSES,
    "q50_burst_answers": BURST_ANSWERS,
    "q52_upload_refusals": """WITH sized AS (SELECT page_id, strlen(coalesce(html, '')) + CASE WHEN page_id % 5 <> 0 THEN 8 ELSE 1 END AS n FROM pages),
judged AS (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN 1 WHEN n > 4000 THEN 2 WHEN page_id % 5 = 0 THEN 3 END AS broken FROM sized)
SELECT page_id AS request_id, CASE broken WHEN 2 THEN 413 WHEN 1 THEN 400 WHEN 3 THEN 400 ELSE 200 END AS status, CASE broken WHEN 1 THEN 'File uploaded must be an image.' WHEN 2 THEN 'Uploaded image is too large.' WHEN 3 THEN 'Could not decode image file.' END AS detail FROM judged""",
    "q51_evidence_by_scan": SCORED + " SELECT scan_id, count(*) AS n, min(id) AS least, max(id) AS greatest, " + ", ".join(f"CAST(sum(CAST(round({c} * 1000000) AS BIGINT)) AS BIGINT) AS {c}" for c in ("total_score", "num_score", "name_score", "hp_score", "final_score")) + ", CAST(sum(n_evidence) AS BIGINT) AS n_evidence, count(*) FILTER (strong) AS strong, count(*) FILTER (set_identity) AS set_identity FROM scored GROUP BY scan_id",
    "q45_request_metrics": f"SELECT 'POST' AS method, '/' || event_type AS path, CASE WHEN event_id % 10 <> 0 THEN CASE WHEN event_id % 7 = 0 THEN 413 ELSE 200 END END AS status, count(*) AS requests, {_two('avg(event_id % 1000 * 8)')} AS mean_ms, CAST(max(event_id % 1000 * 8) AS DOUBLE) AS longest_ms FROM events GROUP BY ALL",
    "q46_normalised_vectors": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE) * (vec_id % 9)) AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM v), w AS (SELECT vec_id, list_transform(v, lambda x: CASE WHEN n > 0 THEN x / n ELSE x END) AS w FROM n)
SELECT vec_id, round(list_sum(w), 6) AS total, round(list_dot_product(w, w), 6) AS squares FROM w""",
    "q47_search_results": with_views("cards", "scans") + SUBSET_CHAIN + """, s AS (SELECT DISTINCT kind, key FROM chain WHERE step > 0)
SELECT kind, key, count(DISTINCT id) AS n, min(id) AS first FROM s JOIN cards c ON (kind = 'name' AND lower(c.name) = key) OR (kind = 'start' AND starts_with(lower(c.name), key)) OR (kind = 'number' AND c.number = key) GROUP BY kind, key""",
    "q48_corners": "WITH p AS (SELECT vec_id, CAST(embedding[2 * i + 1] AS DOUBLE) AS x, CAST(embedding[2 * i + 2] AS DOUBLE) AS y FROM embeddings, range(4) AS r(i)) SELECT vec_id, "
    + ", ".join(f"{f}({a}, {k}) AS {c}_{a}" for c, f, k in (("top_left", "arg_min", "x + y"), ("top_right", "arg_min", "y - x"), ("bottom_right", "arg_max", "x + y"), ("bottom_left", "arg_max", "y - x")) for a in ("x", "y"))
    + " FROM p GROUP BY vec_id",
    "q49_reading_order": "SELECT l_orderkey, string_agg(CAST(l_suppkey AS VARCHAR), ',' ORDER BY l_partkey % 50, l_linenumber, l_partkey, l_suppkey) AS names, min(l_partkey % 50) AS x1, min(l_linenumber) AS y1, max(l_partkey % 50 + 10) AS x2, max(l_linenumber + 3) AS y2 FROM lineitem GROUP BY l_orderkey",
}
