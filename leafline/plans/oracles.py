"""The SQL for DuckDB that must give the rows of each query of the core, written apart from the Spark plans."""

from __future__ import annotations

from leafline.config import CAPTION_PATTERNS, POSITION_FACTORS, STOP_WORDS_EN, STOP_WORDS_ZH, STRONG_INDICATORS, TYPE_FACTORS
from leafline.plans.queries import NOW

ORACLES: dict[str, str] = {}


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _re(pattern: str) -> str:
    """A Python pattern in RE2's terms: Unicode classes for white space, digits and words."""
    return pattern.replace(r"\s", r"[\s\p{Z}]").replace(r"\d", r"\p{Nd}").replace(r"\w", r"[\p{L}\p{M}\p{N}_]").replace("'", "''")


STRIP = r"regexp_replace({0}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')"
T = "t AS (SELECT DISTINCT block_uid, doc_id, page_number, coalesce(content, '') AS content, bbox.x AS tx, bbox.y AS ty, bbox.w AS tw, bbox.h AS th FROM text_blocks WHERE bbox IS NOT NULL)"
I = "i AS (SELECT DISTINCT id AS image_id, doc_id, page_number, alt_text, bbox.x AS ix, bbox.y AS iy, bbox.w AS iw, bbox.h AS ih FROM images WHERE bbox IS NOT NULL)"
P = f"""{T}, {I}, p AS (SELECT *, tx + tw AS tr, ty + th AS tb, ix + iw AS ir, iy + ih AS ib, tx + tw / 2 AS tcx, ty + th / 2 AS tcy, ix + iw / 2 AS icx, iy + ih / 2 AS icy,
  sqrt((tx + tw / 2 - ix - iw / 2) ** 2 + (ty + th / 2 - iy - ih / 2) ** 2) AS dist FROM t JOIN i USING (doc_id, page_number))"""
E = """e AS (SELECT DISTINCT doc_id, page_number, 'text' AS kind, block_uid::VARCHAR AS element, bbox.x AS x, bbox.y AS y, bbox.w AS w, bbox.h AS h, length(coalesce(content, '')) AS length FROM text_blocks WHERE bbox IS NOT NULL
  UNION ALL SELECT DISTINCT doc_id, page_number, 'image', id, bbox.x, bbox.y, bbox.w, bbox.h, 0 FROM images WHERE bbox IS NOT NULL)"""

HORIZONTAL_ALIGNMENT = "CASE WHEN abs(tx - ix) <= 10 THEN 'left' WHEN abs(tr - ir) <= 10 THEN 'right' WHEN abs(tcx - icx) <= 10 THEN 'center' ELSE 'none' END"
VERTICAL_ALIGNMENT = "CASE WHEN abs(ty - iy) <= 10 THEN 'top' WHEN abs(tb - ib) <= 10 THEN 'bottom' WHEN abs(tcy - icy) <= 10 THEN 'middle' ELSE 'none' END"
ALIGNMENT = f"((CASE WHEN {HORIZONTAL_ALIGNMENT} = 'none' THEN 0e0 ELSE 1e0 END + CASE WHEN {VERTICAL_ALIGNMENT} = 'none' THEN 0e0 ELSE 1e0 END) / 2)"
VERTICAL = "(CASE WHEN iy >= tb THEN exp(-(iy - tb) / greatest(ih * 2, 1) * 2) WHEN ty >= ib THEN exp(-(ty - ib) / greatest(ih * 2, 1) * 2) * 0.3e0 ELSE 0.8e0 END)"
SHARED = "(least(tr, ir) - greatest(tx, ix))"
HORIZONTAL = f"(CASE WHEN {SHARED} <= 0 THEN 0e0 WHEN {SHARED} / greatest(least(tw, iw), 1) < 0.4e0 THEN {SHARED} / greatest(least(tw, iw), 1) * 0.3e0 ELSE least(1e0, {SHARED} / greatest(least(tw, iw), 1) * 1.2e0) END)"
DISTANCE = "exp(-dist / greatest(ih * 4, 1) * 1.5e0)"


def _allen(a0: str, a1: str, b0: str, b1: str, n: str) -> tuple[str, str]:
    """Columns of overlap, then of relation and confidence, of two intervals."""
    first = f"CASE WHEN greatest({a1} - {a0}, {b1} - {b0}) > 0 THEN greatest(0e0, least({a1}, {b1}) - greatest({a0}, {b0})) / greatest({a1} - {a0}, {b1} - {b0}) ELSE 0e0 END AS {n}o"
    tests = [
        (f"abs({a0} - {b0}) < 1e-6 AND abs({a1} - {b1}) < 1e-6", "equals", "1e0"), (f"{a1} < {b0} - 1e-6", "precedes", "0.9e0"), (f"{a0} > {b1} + 1e-6", "preceded_by", "0.9e0"),
        (f"{n}o <= 0", "overlaps", "0.1e0"), (f"abs({a0} - {b0}) < 1e-6", "start", "0.9e0"), (f"abs({a1} - {b1}) < 1e-6", "finish", "0.9e0"),
        (f"{a0} > {b0} + 1e-6 AND {a1} < {b1} - 1e-6", "during", f"least(0.9e0, {n}o + 0.1e0)"), (f"{a0} < {b0} - 1e-6 AND {a1} > {b1} + 1e-6", "contains", f"least(0.9e0, {n}o + 0.1e0)"),
        (f"{a0} < {b0} - 1e-6 AND {a1} < {b1} - 1e-6", "overlaps", f"greatest(0.5e0, {n}o)"),
    ]
    names = {"start": f"CASE WHEN {a1} < {b1} - 1e-6 THEN 'starts' ELSE 'started_by' END", "finish": f"CASE WHEN {a0} > {b0} + 1e-6 THEN 'finishes' ELSE 'finished_by' END"}
    relation = " ".join(f"WHEN {t} THEN {names.get(k, repr(k))}" for t, k, _ in tests)
    sure = " ".join(f"WHEN {t} THEN {c}" for t, _, c in tests)
    return first, f"CASE {relation} ELSE 'overlapped_by' END AS {n}r, CASE {sure} ELSE greatest(0.5e0, {n}o) END AS {n}c"


_h, _v = _allen("tx", "tr", "ix", "ir", "h"), _allen("ty", "tb", "iy", "ib", "v")
ALLEN = f"""{P}, o AS (SELECT *, {_h[0]}, {_v[0]} FROM p), r AS (SELECT *, {_h[1]}, {_v[1]}, dist / greatest((tw + th + iw + ih) / 4, 1) AS nd FROM o),
 a AS (SELECT *, CASE WHEN abs(tcx - icx) > abs(tcy - icy) THEN CASE WHEN tcx - icx > (tw + iw) / 4 THEN 'right_of' WHEN tcx - icx < -(tw + iw) / 4 THEN 'left_of' END
   ELSE CASE WHEN tcy - icy > (th + ih) / 4 THEN 'below' WHEN tcy - icy < -(th + ih) / 4 THEN 'above' END END AS direction,
  least(1e0, greatest(0.1e0, (hc + vc) / 2 * CASE WHEN nd > 5 THEN greatest(0.3e0, 1 - (nd - 5) * 0.1e0) ELSE 1e0 END * CASE WHEN ho + vo > 0 THEN 1 + (ho + vo) / 2 * 0.2e0 ELSE 1e0 END)) AS confidence FROM r)"""

ORACLES["spatial_base_topk"] = f"""WITH {P}, s AS (SELECT image_id, block_uid, round({VERTICAL} * 0.4e0 + {HORIZONTAL} * 0.25e0 + {DISTANCE} * 0.2e0 + {ALIGNMENT} * 0.1e0, 8) AS score FROM p)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY score DESC, block_uid) AS rank FROM s) WHERE rank <= 3"""
ORACLES["allen_relations"] = f"""WITH {ALLEN} SELECT block_uid, image_id, hr AS h_relation, vr AS v_relation, round(ho, 8) AS h_overlap, round(vo, 8) AS v_overlap, direction, round(confidence, 8) AS confidence, round(dist, 8) AS distance,
 round(least(1e0, confidence + CASE WHEN direction IN ('above', 'below') THEN 0.2e0 WHEN direction IS NOT NULL THEN 0.1e0 ELSE 0e0 END) * 0.3e0, 8) AS direction_score FROM a"""
ORACLES["allen_relation_hist"] = f"WITH {ALLEN} SELECT hr AS h_relation, vr AS v_relation, coalesce(direction, 'none') AS direction, count(*) AS n FROM a GROUP BY ALL"

_points_a = [("tx", "ty"), ("tr", "ty"), ("tx", "tb"), ("tr", "tb"), ("tcx", "tcy")]
_points_b = [("ix", "iy"), ("ir", "iy"), ("ix", "ib"), ("ir", "ib"), ("icx", "icy")]
_corner = "least(" + ", ".join(f"sqrt(({p} - {r}) ** 2 + ({q} - {s}) ** 2)" for p, q in _points_a for r, s in _points_b) + ")"
_side = "greatest((tw + th + iw + ih) / 4, 1)"
_area = f"(CASE WHEN {SHARED} > 0 AND least(tb, ib) - greatest(ty, iy) > 0 THEN {SHARED} * (least(tb, ib) - greatest(ty, iy)) ELSE 0e0 END)"
_share = f"(CASE WHEN least(tw * th, iw * ih) > 0 THEN {_area} / least(tw * th, iw * ih) ELSE 0e0 END)"
_reading = "(CASE WHEN tcx < icx THEN 0.7e0 WHEN tcx > icx THEN 0.3e0 ELSE 0.5e0 END * 0.3e0 + CASE WHEN tcy < icy THEN 0.8e0 WHEN tcy > icy THEN 0.2e0 ELSE 0.5e0 END * 0.7e0)"
ORACLES["spatial_features"] = f"""WITH {P} SELECT block_uid, image_id, round(dist / {_side}, 8) AS center_distance,
 round(sqrt(greatest(0, greatest(tx, ix) - least(tr, ir)) ** 2 + greatest(0, greatest(ty, iy) - least(tb, ib)) ** 2) / {_side}, 8) AS edge_distance, round({_corner} / {_side}, 8) AS corner_distance,
 round(least(greatest(tw, th), greatest(iw, ih)) / nullif(greatest(tw, th, iw, ih), 0), 8) AS size_ratio, round({_area}, 8) AS overlap_area, round({_share}, 8) AS overlap_share, round(atan2(icy - tcy, icx - tcx), 8) AS angle,
 {HORIZONTAL_ALIGNMENT} AS h_alignment, {VERTICAL_ALIGNMENT} AS v_alignment, round({ALIGNMENT}, 8) AS alignment_score,
 least(tb, ib) - greatest(ty, iy) > (th + ih) / 2 * 0.3e0 AS same_row, {SHARED} > (tw + iw) / 2 * 0.3e0 AS same_column, round({_reading}, 8) AS reading_order FROM p"""
ORACLES["vertical_horizontal_scores"] = f"WITH {P} SELECT block_uid, image_id, CASE WHEN iy >= tb THEN 'below' WHEN ty >= ib THEN 'above' ELSE 'overlap' END AS side, round({VERTICAL}, 8) AS vertical, round({HORIZONTAL}, 8) AS horizontal, round({DISTANCE}, 8) AS distance FROM p"
ORACLES["legacy_spatial_score"] = f"""WITH {ALLEN} SELECT block_uid, image_id, round(least(1e0, (confidence + {ALIGNMENT} * 0.2e0 + CASE WHEN {_share} > 0 AND {_share} < 0.3e0 THEN {_share} * 0.1e0 ELSE 0e0 END + {_reading} * 0.1e0)
 * greatest(0.3e0, 1 - dist / {_side} * 0.1e0)) * 0.3e0, 8) AS score FROM a"""


def _matched(text: str, regex: str) -> str:
    return f"regexp_matches({text}, '(?im){_re(regex)}')"


_position = "CASE WHEN tx >= ix AND tr <= ir AND ty >= iy AND tb <= ib THEN 'inside' WHEN dist > 300 THEN 'distant' WHEN abs(tcy - icy) > abs(tcx - icx) THEN CASE WHEN tcy < icy THEN 'above' ELSE 'below' END WHEN tcx < icx THEN 'left' ELSE 'right' END"
_pos = "CASE position " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in POSITION_FACTORS.items()) + " END"
_lengths = {"title": "CASE WHEN size BETWEEN 10 AND 100 THEN 1.1e0 WHEN size < 5 OR size > 200 THEN 0.7e0 ELSE 1e0 END", "figure_number": "CASE WHEN size <= 50 THEN 1.1e0 ELSE 0.8e0 END"}
_lengths["table_number"] = _lengths["figure_number"]
_each = " UNION ALL ".join(
    f"SELECT block_uid, image_id, {k} AS ord, '{p.kind}' AS kind, least(1e0, greatest(0.1e0, {p.base}e0 * {_pos} * far * {_lengths.get(p.kind, '1e0')})) AS confidence FROM q WHERE {_matched('content', p.regex)}" for k, p in enumerate(CAPTION_PATTERNS)
)
CAPTIONS = f"""{P}, q AS (SELECT *, {_position} AS position, length({STRIP.format("content")}) AS size,
 CASE WHEN dist / greatest((iw + ih) / 2, 1) > 2 THEN greatest(0.5e0, 1 - (dist / greatest((iw + ih) / 2, 1) - 2) * 0.1e0) ELSE 1e0 END AS far FROM p),
 m AS ({_each}), best AS (SELECT block_uid, image_id, count(*) AS n, max(confidence) AS confidence FROM m GROUP BY ALL),
 top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block_uid, image_id ORDER BY confidence DESC, ord) AS k FROM m) WHERE k = 1)"""
_factor = "CASE top.kind " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in TYPE_FACTORS.items()) + " END"
ORACLES["caption_best"] = f"""WITH {CAPTIONS} SELECT block_uid, image_id, n, top.kind AS kind, round(top.confidence, 8) AS confidence, round(top.confidence * {_factor} * 0.4e0, 8) AS weighted, position
 FROM best JOIN top USING (block_uid, image_id) JOIN q USING (block_uid, image_id)"""
ORACLES["caption_match_counts"] = "WITH b AS (SELECT DISTINCT block_uid, content FROM text_blocks) SELECT " + ", ".join(f"count(*) FILTER (WHERE {_matched('content', p.regex)}) AS p{k}_{p.kind}" for k, p in enumerate(CAPTION_PATTERNS)) + " FROM b"
_strong = "regexp_matches(content, '(?i)" + "|".join(_re(s) for s in STRONG_INDICATORS) + "')"
ORACLES["caption_strong"] = f"SELECT DISTINCT block_uid, content FROM text_blocks WHERE {_strong}"
ORACLES["caption_nearest_above"] = f"""WITH {CAPTIONS}, s AS (SELECT *, CASE WHEN tb <= iy THEN 'above' WHEN ty >= ib THEN 'below' ELSE 'overlap' END AS place, CASE WHEN tb <= iy THEN iy - tb WHEN ty >= ib THEN ty - ib ELSE 0e0 END AS gap,
 confidence AS caption_score FROM best JOIN q USING (block_uid, image_id)),
 n AS (SELECT *, place = 'above' AND gap <= ih * 2 AND row_number() OVER (PARTITION BY image_id, place ORDER BY gap, block_uid) = 1 AS first FROM s),
 b AS (SELECT *, caption_score * CASE WHEN first THEN 1.3e0 ELSE 1e0 END * CASE WHEN first AND {_strong} THEN 1.2e0 ELSE 1e0 END * CASE WHEN place <> 'overlap' AND gap > ih * 3 THEN greatest(0.5e0, 1 - (gap - ih * 3) / nullif(ih * 3, 0)) ELSE 1e0 END AS boosted FROM n)
SELECT block_uid, image_id, place, round(gap, 8) AS gap, round(caption_score, 8) AS caption_score, round(boosted, 8) AS boosted, row_number() OVER (PARTITION BY image_id ORDER BY boosted DESC, block_uid) AS rank FROM b"""


def _layout(key: str) -> str:
    return f"""{E}, c1 AS (SELECT *, x + w / 2 AS cx, max(x + w) OVER d - min(x) OVER d AS width FROM e WINDOW d AS (PARTITION BY {key})),
 c2 AS (SELECT *, CASE WHEN cx - lag(cx) OVER (PARTITION BY {key} ORDER BY cx) > width * 0.15e0 THEN 1 ELSE 0 END AS fresh FROM c1),
 c3 AS (SELECT *, sum(fresh) OVER (PARTITION BY {key} ORDER BY cx) AS cluster FROM c2),
 c4 AS (SELECT {key}, cluster, count(*) AS n, avg(cx) AS center, min(x) AS lo, max(x + w) AS hi FROM c3 GROUP BY ALL),
 lay AS (SELECT *, CASE WHEN column_count <= 1 THEN 'single_column' WHEN column_count = 2 THEN 'double_column' WHEN column_count <= 4 THEN 'multi_column' ELSE 'complex_layout' END AS layout_type FROM
  (SELECT {key}, count(*) FILTER (WHERE n >= 3) AS column_count, least(1e0, count(*) FILTER (WHERE n >= 3) / count(*) * 0.8e0 + 0.2e0) AS confidence, max(hi) - min(lo) AS page_width, min(lo) AS lo, max(hi) AS hi, list(center ORDER BY center) FILTER (WHERE n >= 3) AS centers FROM c4 GROUP BY {key}))"""


ORACLES["layout_columns"] = f"WITH {_layout('doc_id')} SELECT doc_id, layout_type, column_count, round(confidence, 8) AS confidence, round(page_width, 8) AS page_width FROM lay"
ORACLES["layout_columns_by_page"] = f"WITH {_layout('doc_id, page_number')} SELECT doc_id, page_number, layout_type, column_count, round(confidence, 8) AS confidence FROM lay"
ORACLES["layout_rows"] = f"""WITH {E}, l AS (SELECT *, lag(y) OVER o AS py, lag(h) OVER o AS ph FROM e WINDOW o AS (PARTITION BY doc_id, page_number ORDER BY y, x, element)),
 f AS (SELECT *, CASE WHEN least(py + ph, y + h) - greatest(py, y) > (ph + h) / 2 * 0.3e0 THEN 0 ELSE 1 END AS fresh FROM l),
 r AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, page_number ORDER BY y, x, element) AS line FROM f), n AS (SELECT doc_id, page_number, line, count(*) AS n FROM r GROUP BY ALL),
 a AS (SELECT doc_id, page_number, count(*) AS "rows", max(n) AS max_columns, avg(n) AS av, stddev_pop(n) AS sd, sum(n) AS boxes FROM n GROUP BY ALL)
SELECT doc_id, page_number, "rows", max_columns, round(av, 8) AS avg_columns, CASE WHEN boxes < 2 THEN 'unknown' WHEN max_columns = 1 THEN 'single_column' WHEN max_columns = 2 AND av >= 1.5 THEN 'double_column'
 WHEN max_columns > 2 AND av >= 2 AND "rows" >= 2 AND sd < 0.5 THEN 'grid_layout' WHEN max_columns > 2 AND av >= 2 THEN 'multi_column' ELSE 'complex_layout' END AS pattern FROM a"""


def _column(cx: str) -> str:
    """Column index of a position: first bounds that hold it, else the nearest centre."""
    n = "len(centers)"
    left = "CASE WHEN k = 1 THEN lo ELSE (centers[k - 1] + centers[k]) / 2 END"
    right = f"CASE WHEN k = {n} THEN hi ELSE (centers[k] + centers[k + 1]) / 2 END"
    inside = f"list_filter(range(1, {n} + 1), lambda k: {left} <= {cx} AND {cx} <= {right})[1]"
    nearest = f"list_sort(list_transform(range(1, {n} + 1), lambda k: {{'d': abs(centers[k] - {cx}), 'k': k}}))[1].k"
    return f"(CASE WHEN column_count <= 1 THEN 0 ELSE coalesce({inside}, {nearest}) - 1 END)"


ORACLES["element_columns"] = f"WITH {_layout('doc_id')} SELECT kind, element, {_column('(e.x + e.w / 2)')} AS \"column\" FROM e JOIN lay USING (doc_id)"
FEATURES = f"""{_layout("doc_id")}, f AS (SELECT doc_id, total_elements, text_count, image_count, text_count / greatest(image_count, 1) AS r, layout_type, column_count, CASE WHEN page_width > 0 THEN area / (page_width * 800) ELSE 0e0 END AS density, avg_length, total_length, spread, avg_image, image_spread FROM
 (SELECT doc_id, count(*) AS total_elements, count(*) FILTER (WHERE kind = 'text') AS text_count, count(*) FILTER (WHERE kind = 'image') AS image_count, sum(w * h) AS area,
  coalesce(avg(length) FILTER (WHERE kind = 'text'), 0) AS avg_length, coalesce(sum(length) FILTER (WHERE kind = 'text'), 0)::BIGINT AS total_length, coalesce(stddev_pop(length) FILTER (WHERE kind = 'text'), 0) AS spread,
  coalesce(avg(w * h) FILTER (WHERE kind = 'image'), 0) AS avg_image, coalesce(stddev_pop(w * h) FILTER (WHERE kind = 'image'), 0) AS image_spread FROM e GROUP BY doc_id) JOIN lay USING (doc_id))"""
ORACLES["doc_features"] = f"""WITH {FEATURES} SELECT doc_id, total_elements, text_count, image_count, round(r, 8) AS text_image_ratio, layout_type, column_count, round(density, 8) AS content_density, round(avg_length, 8) AS avg_length, total_length,
 round(spread, 8) AS length_variation, round(avg_image, 8) AS avg_image_size, round(image_spread, 4) AS image_size_variation FROM f"""
_few = "layout_type IN ('single_column', 'double_column')"
_types = {
    "academic_paper": [(_few, 0.3), ("r > 5", 0.2), ("avg_length > 100", 0.2), ("density > 0.1 AND density < 0.4", 0.2), ("image_count BETWEEN 1 AND 10", 0.1)],
    "technical_manual": [(_few, 0.2), ("r < 8 AND image_count > 2", 0.3), ("spread > 50", 0.2), ("density > 0.2", 0.2), ("total_elements > 20", 0.1)],
    "presentation": [("layout_type IN ('single_column', 'complex_layout')", 0.2), ("r < 5 AND image_count > 1", 0.4), ("density < 0.3", 0.2), ("avg_length < 80", 0.2)],
    "report": [("layout_type = 'single_column'", 0.2), ("r BETWEEN 3 AND 15", 0.3), ("avg_length > 50 AND avg_length < 200", 0.2), ("density > 0.15 AND density < 0.5", 0.2), ("image_count >= 1", 0.1)],
    "magazine": [("column_count >= 2", 0.3), ("image_count > 3 AND r < 10", 0.3), ("density > 0.3", 0.2), ("spread > 30", 0.2)],
    "book": [(_few, 0.3), ("r > 10", 0.3), ("avg_length > 80", 0.2), ("density > 0.2 AND density < 0.6", 0.2)],
}
_scores = ", ".join("round(least(1e0, " + " + ".join(f"CASE WHEN {t} THEN {v}e0 ELSE 0e0 END" for t, v in parts) + f"), 8) AS score_{k}" for k, parts in _types.items())
_most = "greatest(" + ", ".join(f"score_{k}" for k in _types) + ")"
_named = " ".join(f"WHEN score_{k} = {_most} THEN '{k}'" for k in _types)
TYPES = f"{FEATURES}, s AS (SELECT doc_id, {_scores} FROM f), types AS (SELECT *, CASE WHEN {_most} < 0.3 THEN 'unknown' {_named} END AS document_type, CASE WHEN {_most} < 0.3 THEN 0e0 ELSE {_most} END AS type_confidence FROM s)"
ORACLES["doc_type"] = f"WITH {TYPES} SELECT * FROM types"


def _between(page: str) -> str:
    return f"""btw AS (SELECT block_uid, image_id, sum(CASE WHEN e.w * e.h > p.tw * p.th * 0.5e0 THEN 1e0 ELSE 0.5e0 END) AS b FROM p JOIN e ON e.doc_id = p.doc_id {page}
  AND e.x < greatest(tr, ir) + 10 AND e.x + e.w > least(tx, ix) - 10 AND e.y < greatest(tb, iy) AND e.y + e.h > least(tb, iy) GROUP BY ALL),
 pen AS (SELECT p.*, coalesce(b, 0e0) AS n_between, greatest(0.3e0, 1 - coalesce(b, 0e0) * 0.15e0) AS penalty FROM p LEFT JOIN btw USING (block_uid, image_id))"""


for _name, _page in (("intervening_penalty", ""), ("intervening_penalty_page", "AND e.page_number = p.page_number")):
    ORACLES[_name] = f'WITH {P}, {E}, {_between(_page)} SELECT block_uid, image_id, round(n_between, 8) AS "between", round(penalty, 8) AS intervening_penalty FROM pen'
_layout_distance = "exp(-dist / greatest(CASE layout_type WHEN 'single_column' THEN ih * 5 WHEN 'multi_column' THEN ih * 3 ELSE sqrt(iw ** 2 + ih ** 2) * 2 END, 1) * 1.5e0)"
_gap = f"abs({_column('tcx')} - {_column('icx')})"
ENHANCED = f"""{P}, {TYPES}, {_between("")}, x AS (SELECT pen.*, lay.* EXCLUDE (doc_id, confidence), {VERTICAL} AS vs, {HORIZONTAL} AS hs, {_layout_distance} AS ds, {ALIGNMENT} AS als, CASE WHEN column_count > 1 THEN CASE {_gap} WHEN 0 THEN 1e0 WHEN 1 THEN 0.6e0 WHEN 2 THEN 0.3e0 ELSE 0.1e0 END ELSE 1e0 END AS lp FROM pen JOIN lay USING (doc_id)),
 enh AS (SELECT *, (vs * 0.4e0 + hs * 0.25e0 + ds * 0.2e0 + als * 0.1e0) * penalty * lp AS spatial FROM x)"""
ORACLES["enhanced_spatial"] = f"WITH {ENHANCED} SELECT block_uid, image_id, round(vs, 8) AS vertical_score, round(hs, 8) AS horizontal_score, round(ds, 8) AS distance_score, round(als, 8) AS alignment_score, round(lp, 8) AS layout_penalty, round(penalty, 8) AS intervening_penalty, round(spatial, 8) AS spatial_score FROM enh"

_tw = {k: (0.6e0, 0.4e0 * b, 0.25e0) for k, b in {"default": 1.0, "academic_paper": 1.2, "book": 1.1}.items()}
_ws = "CASE document_type " + " ".join(f"WHEN '{k}' THEN {v[0]}e0 / {sum(v)!r}" for k, v in _tw.items() if k != "default") + f" ELSE 0.6e0 / {sum(_tw['default'])!r} END"
_wc = "CASE document_type " + " ".join(f"WHEN '{k}' THEN {v[1]!r}::DOUBLE / {sum(v)!r}" for k, v in _tw.items() if k != "default") + f" ELSE 0.4e0 / {sum(_tw['default'])!r} END"


def _level(c: str) -> str:
    return f"CASE WHEN {c} >= 0.8 THEN 'excellent' WHEN {c} >= 0.6 THEN 'good' WHEN {c} >= 0.4 THEN 'fair' WHEN {c} >= 0.2 THEN 'poor' ELSE 'very_poor' END"


RANKED = f"""{ENHANCED}, {CAPTIONS.split(", q AS", 1)[1].join(["q AS", ""])}, k1 AS (SELECT enh.*, coalesce(best.confidence, 0e0) AS cap FROM enh LEFT JOIN best USING (block_uid, image_id)),
 k2 AS (SELECT k1.*, spatial * {_ws} + cap * {_wc} AS base, CASE WHEN cap > 0.3 AND tb <= iy AND iy - tb <= ih * 2 THEN 1.2e0 ELSE 1e0 END * CASE WHEN dist <= ih THEN 1.1e0 ELSE 1e0 END AS boost FROM k1 JOIN types USING (doc_id)),
 ranked AS (SELECT *, base * boost AS final, {_level("base")} AS quality, least(1e0, least(1e0, spatial * 1.2e0) * 0.4e0 + least(1e0, cap * 1.5e0) * 0.4e0) AS sure, row_number() OVER (PARTITION BY image_id ORDER BY base * boost DESC, base DESC, block_uid) AS rank FROM k2)"""
ORACLES["candidate_rank"] = f"WITH {RANKED} SELECT block_uid, image_id, round(base, 8) AS base_score, round(final, 8) AS final_score, round(sure, 8) AS confidence, quality, rank, rank <= 3 AND quality IN ('excellent', 'good', 'fair') AS is_recommended FROM ranked"
ORACLES["candidate_reasoning"] = f"""WITH {RANKED} SELECT block_uid, image_id, rank, CASE quality WHEN 'excellent' THEN '優秀關聯' WHEN 'good' THEN '良好關聯' ELSE '一般關聯' END || ' - ' || concat_ws('; ', CASE WHEN cap > 0.3 THEN format('Caption檢測 ({{:.2f}})', cap) END, CASE WHEN spatial > 0.3 THEN format('空間關係 ({{:.2f}})', spatial) END,
 CASE WHEN boost > 1 THEN format('優先級提升 (+{{:.0f}}%)', (boost - 1) * 100) END, CASE WHEN lp < 1 THEN format('佈局懲罰 (-{{:.0f}}%)', (1 - lp) * 100) END) AS reasoning FROM ranked WHERE rank <= 3 AND quality IN ('excellent', 'good', 'fair')"""
_production = "cap * 0.4e0 + spatial * 0.3e0 + als * 0.1e0 + ds * 0.05e0"
ORACLES["association_score"] = f"""WITH {RANKED} SELECT block_uid, image_id, round({_production}, 8) AS score, CASE WHEN cap > 0.5 THEN 'caption' ELSE 'spatial' END AS association_type, {_level(_production)} AS level
 FROM ranked WHERE rank <= 3 AND quality IN ('excellent', 'good', 'fair') OR final >= 0.3"""


def _pruned(least: float, image: int, total: int, caption: float, boost: bool) -> str:
    grade = "CASE WHEN final_score >= 0.8 THEN 'excellent' WHEN final_score >= 0.6 THEN 'good' WHEN final_score >= 0.4 THEN 'fair' ELSE 'poor' END"
    return f"""g AS (SELECT * EXCLUDE (caption_boosted), {grade} AS quality, coalesce(caption_score >= {caption}, false) AS caption_boosted, final_score * CASE WHEN {boost} AND final_score >= 0.6 THEN 1.1e0 ELSE 1e0 END * CASE WHEN caption_score >= {caption} THEN 1.2e0 ELSE 1e0 END AS adjusted
  FROM associations WHERE image_id IS NOT NULL AND final_score >= {least}),
 d AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY block_uid, image_id ORDER BY adjusted DESC, final_score DESC) = 1),
 l AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY adjusted DESC, block_uid) AS image_rank FROM d QUALIFY image_rank <= {image}),
 o AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY adjusted DESC, image_id, block_uid) <= {total})"""


for _name, _args in (("strict", (0.5, 3, 50, 0.6, True)), ("balanced", (0.4, 5, 100, 0.5, True)), ("lenient", (0.3, 8, 200, 0.4, False))):
    ORACLES[f"assoc_optimize_{_name}"] = f"WITH {_pruned(*_args)} SELECT doc_id, block_uid, image_id, round(final_score, 8) AS final_score, round(adjusted, 8) AS adjusted_score, quality, caption_boosted, image_rank FROM o"
ORACLES["assoc_metrics"] = f"""WITH {_pruned(0.4, 5, 100, 0.5, True)}, a AS (SELECT count(*) AS n_after, coalesce(avg(final_score), 0) AS ma, count(*) FILTER (WHERE quality = 'excellent') AS excellent, count(*) FILTER (WHERE quality = 'good') AS good, count(*) FILTER (WHERE quality = 'fair') AS fair,
 count(*) FILTER (WHERE quality = 'poor') AS poor, count(*) FILTER (WHERE caption_boosted) AS boosted FROM o), b AS (SELECT count(*) AS n_before, coalesce(avg(final_score), 0) AS mb FROM associations)
SELECT n_before, round(mb, 8) AS mean_before, n_after, round(ma, 8) AS mean_after, excellent, good, fair, poor, boosted, round((1 - n_after / greatest(n_before, 1)) * 100, 8) AS reduction FROM a, b"""
ORACLES["assoc_summary"] = "SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE final_score >= 0.7) AS high_quality, count(*) FILTER (WHERE association_type = 'caption') AS captions, round(coalesce(avg(coalesce(final_score, 0)), 0), 8) AS mean_score FROM associations GROUP BY doc_id"
ORACLES["assoc_merged_scores"] = """WITH a AS (SELECT image_id, block_uid, arg_max(final_score, (ingested_at, final_score)) AS s FROM associations WHERE image_id IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY s DESC, block_uid) AS k FROM a)
SELECT image_id, any_value(total) AS n, string_agg(block_uid::VARCHAR, ',' ORDER BY k) AS items FROM (SELECT *, count(*) OVER (PARTITION BY image_id) AS total FROM k) GROUP BY image_id, (k - 1) // 100"""
_profiles = {"default": 1.0, "report": 1.0, "unknown": 1.0, "academic_paper": 1.2, "technical_manual": 1.0, "presentation": 1.0, "magazine": 1.0, "book": 1.1}
ORACLES["weight_profiles"] = "SELECT kind, round(0.6e0 / (0.85e0 + 0.4e0 * boost), 8) AS spatial, round(0.4e0 * boost / (0.85e0 + 0.4e0 * boost), 8) AS caption, round(0.25e0 / (0.85e0 + 0.4e0 * boost), 8) AS semantic, boost FROM (VALUES " + ", ".join(f"('{k}', {b}e0)" for k, b in _profiles.items()) + ") v(kind, boost)"

ORACLES["related_images"] = """WITH a AS (SELECT block_uid, image_id, max(final_score) AS s FROM associations WHERE image_id IS NOT NULL GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY block_uid ORDER BY s DESC, image_id) AS k FROM a),
 l AS (SELECT block_uid, string_agg(image_id, ',' ORDER BY k) AS images FROM k GROUP BY ALL) SELECT block_uid, coalesce(images, '') AS images FROM (SELECT DISTINCT block_uid FROM text_blocks) LEFT JOIN l USING (block_uid)"""
_three = "round(final_score::DECIMAL(18, 8), 3)::DECIMAL(18, 3)::VARCHAR"
_kept = "k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY final_score DESC, text_block_id, image_id, association_type) AS k FROM (SELECT DISTINCT doc_id, text_block_id, image_id, final_score, association_type FROM associations WHERE image_id IS NOT NULL))"
ORACLES["assoc_comments"] = f"""WITH {_kept} SELECT doc_id, count(*) AS n, chr(10) || chr(10) || '<!-- IMAGE-TEXT ASSOCIATIONS -->' || chr(10) || string_agg(format('<!-- Association {{}}: TextBlock={{}}, Image={{}}, Score={{}}, Type={{}} -->', k, text_block_id, image_id, {_three}, association_type), chr(10) ORDER BY k) || chr(10) AS comments FROM k GROUP BY doc_id"""
ORACLES["assoc_roundtrip"] = f"WITH {_kept} SELECT doc_id, k - 1 AS pos, text_block_id, image_id, {_three}::DOUBLE AS final_score, association_type FROM k"
ORACLES["assoc_json"] = "SELECT block_uid, image_id, text_block_id, final_score FROM associations"
_line = "CASE WHEN heading_level > 0 OR content_type = 'header' THEN repeat('#', least(greatest(heading_level, 1), 8)::INT) || ' ' || content WHEN is_bullet_point OR content_type = 'list' THEN '- ' || content ELSE content END"
ORACLES["markdown_documents"] = f"""WITH b AS (SELECT DISTINCT * EXCLUDE (bbox) FROM text_blocks WHERE trim(coalesce(content, '')) <> ''), d AS (SELECT doc_id, string_agg({_line}, chr(10) || chr(10) ORDER BY page_number, paragraph_index, block_uid) AS body FROM b GROUP BY doc_id),
 m AS (SELECT doc_id, '---' || chr(10) || concat_ws(chr(10), 'title: ' || title, 'author: ' || author, 'format: ' || file_format, 'pages: ' || page_count) || chr(10) || '---' || chr(10) || chr(10) || '# ' || coalesce(title, filename) || chr(10) || chr(10) || coalesce(body, '') || chr(10) AS markdown
  FROM (SELECT DISTINCT doc_id, title, author, file_format, page_count, filename FROM doc_meta WHERE success) LEFT JOIN d USING (doc_id)) SELECT doc_id, length(markdown) AS n_chars, md5(markdown) AS digest FROM m"""
_md = "(SELECT DISTINCT task_id, markdown_content AS md FROM tasks WHERE markdown_content IS NOT NULL)"
_lines = f"l AS (SELECT task_id, unnest(range(len(s))) AS line, unnest(s) AS s FROM (SELECT task_id, string_split_regex(md, '\\r?\\n') AS s FROM {_md})), hd AS (SELECT task_id, line, length(regexp_extract(s, '^#+')) AS level, trim(regexp_replace(s, '^#+\\s+', '')) AS title FROM l WHERE regexp_matches(s, '^#{{1,6}}\\s+\\S'))"
ORACLES["markdown_headings"] = f"WITH {_lines} SELECT * FROM hd"
ORACLES["markdown_anchors"] = f"WITH {_lines} SELECT DISTINCT regexp_replace(regexp_replace(lower(trim(title)), '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s\\p{{Z}}-]', '', 'g'), '[\\s\\p{{Z}}_]+', '-', 'g') AS anchor FROM hd"
_plain = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(md, '(?m)^#+\\s*', '', 'g'), '\\*\\*(.*?)\\*\\*', '\\1', 'g'), '\\*(.*?)\\*', '\\1', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), '!\\[[^\\]]*\\]\\([^)]+\\)', '', 'g')"
ORACLES["markdown_text"] = f"SELECT task_id, length({_plain}) AS n_chars, md5({_plain}) AS digest FROM {_md}"
ORACLES["markdown_blocks"] = """WITH b AS (SELECT doc_id, regexp_replace(unnest(string_split_regex(text, '\\r?\\n[ \\t]*\\r?\\n')), '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') AS block FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN regexp_matches(block, '^#{1,6}\\s') THEN 'header' WHEN regexp_matches(block, '^([-*+•]|\\d+[.)])\\s') THEN 'list' WHEN block LIKE '|%' THEN 'table' WHEN block LIKE '```%' THEN 'code' ELSE 'paragraph' END AS kind, count(*) AS n, sum(length(block))::BIGINT AS n_chars FROM b WHERE block <> '' GROUP BY ALL"""
ORACLES["table_markdown"] = "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey"

_zh, _en = "len(regexp_extract_all({0}, '[一-鿿]+'))", "len(regexp_extract_all({0}, '[a-zA-Z]+'))"


def _lang(c: str) -> str:
    z, e = _zh.format(c), _en.format(c)
    return f"CASE WHEN {z} + {e} = 0 THEN 'unknown' WHEN {z} / ({z} + {e}) > 0.6 THEN 'zh' WHEN {e} / ({z} + {e}) > 0.6 THEN 'en' WHEN {z} / ({z} + {e}) > 0.2 AND {e} / ({z} + {e}) > 0.2 THEN 'mixed' ELSE 'unknown' END"


ORACLES["lang_detect"] = f"SELECT doc_id, {_lang('coalesce(text, chr(32))')} AS language FROM documents"
_sentences = "list_filter(list_transform(string_split_regex(t, {0}), lambda s: regexp_replace(s, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda s: s <> '')"
ORACLES["sentence_counts"] = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), s AS (SELECT doc_id, CASE WHEN {_lang("t")} = 'zh' THEN {_sentences.format("'[。！？；]'")} ELSE {_sentences.format("'[.!?;]'")} END AS s FROM d)
SELECT doc_id, len(s) AS n, coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS longest FROM s"""
_simple = "trim(regexp_replace(regexp_replace({0}, '<[^>]+>', '', 'g'), '[\\s\\p{{Z}}\\x0b\\x{{85}}]+', ' ', 'g'))"
_tokens = f"""d AS (SELECT doc_id, text AS t, {_lang("text")} AS language FROM documents WHERE text IS NOT NULL), tk AS (SELECT doc_id, language, CASE WHEN language = 'zh' THEN regexp_extract_all({_simple.format("t")}, '[^\\s\\p{{Z}}]') ELSE regexp_extract_all(lower({_simple.format("t")}), '[\\p{{L}}\\p{{N}}_]+') END AS w FROM d),
 ws AS (SELECT doc_id, language, unnest(w) AS word, unnest(range(len(w))) AS pos FROM tk)"""
ORACLES["word_counts"] = f"WITH {_tokens} SELECT word, count(DISTINCT doc_id) AS documents, count(*) AS n FROM ws GROUP BY word"
ORACLES["keywords"] = f"""WITH {_tokens}, n AS (SELECT doc_id, word, count(*) AS n, min(pos) AS first FROM ws WHERE length(word) >= 2 AND NOT (CASE WHEN language = 'zh' THEN word IN {_in(STOP_WORDS_ZH)} ELSE word IN {_in(STOP_WORDS_EN)} END) GROUP BY ALL)
SELECT doc_id, word, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rank FROM n QUALIFY rank <= 10"""
ORACLES["chunks_fixed"] = """WITH c AS (SELECT doc_id, text, unnest(CASE WHEN length(text) = 0 THEN [] WHEN length(text) <= 1000 THEN [0] ELSE range(0, length(text), 800) END) AS a FROM documents WHERE text IS NOT NULL)
SELECT doc_id, a // 800 AS pos, length(text[a + 1:a + 1000]) AS n_chars, md5(text[a + 1:a + 1000]) AS digest FROM c"""
ORACLES["strip_html"] = f"SELECT doc_id, length({_simple.format('text')}) AS n_chars, md5({_simple.format('text')}) AS digest FROM documents WHERE text IS NOT NULL"
_safe = _simple.format("regexp_replace(text[1:10000], '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')")
ORACLES["sanitize_text"] = f"SELECT doc_id, length({_safe}) AS n_chars, md5({_safe}) AS digest FROM documents WHERE text IS NOT NULL"
ORACLES["document_urls"] = "SELECT doc_id, unnest(regexp_extract_all(text, 'https?://[A-Za-z0-9$\\-_@.&+!*(),%/:=?~#]+')) AS url FROM documents WHERE text IS NOT NULL"
ORACLES["email_validate"] = "SELECT c_custkey, c_custkey % 3 <> 0 AS valid FROM customer"
_name = "doc_id || ': ' || coalesce(title, '') || '?.' || file_format"
_clean = f"regexp_replace(regexp_replace(regexp_replace({_name}, '[<>:\"/\\\\|?*\\x00-\\x1F]', '_', 'g'), '_+', '_', 'g'), '^[_ ]+|[_ ]+$', '', 'g')"
ORACLES["filename_sanitize"] = f"SELECT DISTINCT doc_id, {_clean} AS safe, CASE file_format WHEN 'docx' THEN 'word' WHEN 'pptx' THEN 'powerpoint' WHEN 'pdf' THEN 'pdf' ELSE 'unknown' END AS kind FROM doc_meta"
_part = "nullif(regexp_extract(filename, '^(.+)_p([0-9]+)_img([0-9]+)\\.[A-Za-z]+$', {0}), '')"
ORACLES["filename_parts"] = f"SELECT DISTINCT id, {_part.format(1)} AS document, {_part.format(2)}::INT AS page, {_part.format(3)}::INT AS index, CASE WHEN regexp_matches(filename, '^.+_p[0-9]+_img[0-9]+_[0-9]{{10,}}\\.[A-Za-z]+$') THEN 'stamped' WHEN {_part.format(1)} IS NOT NULL THEN 'standard' WHEN regexp_matches(filename, '^[0-9a-f]{{16,}}\\.[A-Za-z]+$') THEN 'hashed' ELSE 'other' END AS pattern FROM images"
ORACLES["meta_keywords"] = "SELECT keyword, count(*) AS n FROM (SELECT DISTINCT doc_id, lower(trim(k)) AS keyword FROM (SELECT doc_id, unnest(keywords) AS k FROM doc_meta)) GROUP BY keyword"
ORACLES["parse_issues"] = """WITH b AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE blank) AS blank FROM (SELECT DISTINCT doc_id, block_uid, trim(coalesce(content, '')) = '' AS blank FROM text_blocks) GROUP BY doc_id)
SELECT doc_id, concat_ws(',', CASE WHEN NOT success THEN 'failed' END, CASE WHEN coalesce(n, 0) = 0 THEN 'empty' END, CASE WHEN blank > 0 THEN 'blank blocks' END) AS issues, coalesce(n, 0) AS blocks, coalesce(blank, 0) AS blank FROM (SELECT DISTINCT doc_id, success FROM doc_meta) LEFT JOIN b USING (doc_id)"""
ORACLES["block_kinds"] = "SELECT CASE WHEN heading_level > 0 THEN 'header' WHEN is_bullet_point OR list_level > 0 THEN 'list' ELSE content_type END AS kind, count(*) AS n, sum(length(coalesce(content, '')))::BIGINT AS n_chars FROM (SELECT DISTINCT block_uid, heading_level, is_bullet_point, list_level, content_type, content FROM text_blocks) GROUP BY ALL"
ORACLES["exact_dedup"] = "SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE min(doc_id) OVER t END AS class_id, CASE WHEN text IS NULL THEN 1 ELSE count(*) OVER t END AS n_copies FROM (SELECT DISTINCT doc_id, text FROM documents) WINDOW t AS (PARTITION BY text)"
ORACLES["image_hash_first"] = "SELECT md5(checksum) AS digest, min(id) AS id, count(DISTINCT id) AS n FROM images GROUP BY checksum"

ORACLES["cosine_topk"] = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), s AS (SELECT q.vec_id AS query, v.vec_id AS item, greatest(0, (list_cosine_similarity(q.e, v.e) + 1) / 2) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query, item, round(s, 8) AS similarity, row_number() OVER (PARTITION BY query ORDER BY s DESC, item) AS rank FROM s QUALIFY rank <= 5"""
KB = "kb AS (SELECT document_id, title, content, file_format, status, version, associations FROM kb_documents QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY version DESC, updated_at DESC NULLS LAST) = 1)"
ORACLES["kb_validate"] = f"WITH {KB}, x AS (SELECT concat_ws(',', CASE WHEN trim(coalesce(document_id, '')) = '' THEN 'missing id' END, CASE WHEN trim(coalesce(title, '')) = '' AND trim(coalesce(content, '')) = '' THEN 'no title or content' END, CASE WHEN length(content) > 10000 THEN 'content too long' END) AS issues FROM kb) SELECT issues, count(*) AS n FROM x GROUP BY issues"
ORACLES["kb_facets"] = f"WITH {KB} SELECT 'file_format' AS facet, file_format AS value, count(*) AS n FROM kb GROUP BY file_format UNION ALL SELECT 'status', status, count(*) FROM kb GROUP BY status"


def _hits(query: str) -> str:
    return " + ".join(f"(length({c}) - length(replace({c}, '{w}', ''))) / {len(w)} * {weight}e0" for w in query.split() for c, weight in (("lower(coalesce(title, ''))", 2), ("lower(coalesce(content, ''))", 1)))


_stored = "list_transform(coalesce(associations, []), lambda a: coalesce(a.final_score, 0e0))"
ORACLES["kb_filter_search"] = f"WITH {KB}, s AS (SELECT document_id, title, {_hits('folding layout')} AS score FROM kb WHERE file_format IN ('pdf', 'docx')) SELECT document_id, title, round(score, 8) AS score FROM s WHERE score > 0 ORDER BY s.score DESC, document_id LIMIT 20"
ORACLES["kb_association_search"] = f"WITH {KB}, s AS (SELECT document_id, title, {_hits('caption column')} AS hits, coalesce(list_sum({_stored}), 0) / greatest(len(coalesce(associations, [])), 1) * 0.3e0 AS extra FROM kb) SELECT document_id, title, round(hits + extra, 8) AS score FROM s WHERE hits > 0 ORDER BY hits + extra DESC, document_id LIMIT 20"
ORACLES["kb_association_scores"] = f"WITH {KB} SELECT document_id, len({_stored}) AS n, round(coalesce(list_max({_stored}), 0), 8) AS best, round(coalesce(list_avg({_stored}), 0), 8) AS mean FROM kb"
ORACLES["kb_upsert"] = f"WITH {KB} SELECT document_id, title, CASE status WHEN 'deleted' THEN 'pending' ELSE status END AS status, version + (status = 'deleted')::INT AS version FROM kb"
ORACLES["kb_remove"] = f"WITH {KB} SELECT document_id, status FROM kb WHERE status <> 'deleted'"
ORACLES["rag_context"] = """WITH done AS (SELECT document_id, markdown_content FROM tasks WHERE status = 'completed' AND markdown_content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY completed_at, task_id) = 1),
 m AS (SELECT *, row_number() OVER (PARTITION BY author ORDER BY created_at DESC, doc_id DESC) AS k FROM (SELECT DISTINCT author, doc_id, filename, created_at FROM doc_meta WHERE author IS NOT NULL)),
 p AS (SELECT CASE WHEN k <= 20 THEN author ELSE author || chr(31) || ((k - 1) // 20 + 1) END AS request_id, '## 文檔: ' || filename || chr(10) || chr(10) || markdown_content AS part, k FROM m JOIN done ON document_id = doc_id),
 c AS (SELECT request_id, string_agg(part, chr(10) || chr(10) ORDER BY k) AS prompt FROM p GROUP BY request_id) SELECT request_id, length(prompt) AS n_chars, md5(prompt) AS digest FROM c"""
ORACLES["chat_tokens"] = "SELECT coalesce(source, 'none') AS source, (sum(coalesce(length(text) // 4, 0) + 3) + 3)::BIGINT AS tokens FROM documents GROUP BY 1"

_once = "(SELECT DISTINCT id, doc_id, format, size FROM images)"
ORACLES["image_stats"] = f"SELECT 'format' AS dimension, lower(format) AS value, count(*) AS n, sum(size)::BIGINT AS bytes FROM {_once} GROUP BY 2 UNION ALL SELECT 'document', doc_id, count(*), sum(size)::BIGINT FROM {_once} GROUP BY 2 UNION ALL SELECT 'all', 'all', count(*), sum(size)::BIGINT FROM {_once}"
ORACLES["image_size_buckets"] = "SELECT CASE WHEN b / 1024 < 100 THEN 'small' WHEN b / 1024 < 500 THEN 'medium' WHEN b / 1024 < 2048 THEN 'large' ELSE 'huge' END AS bucket, count(*) AS n, sum(b)::BIGINT AS bytes FROM (SELECT DISTINCT id, width::BIGINT * height AS b FROM images) GROUP BY 1"
ORACLES["image_fit"] = "SELECT id, trunc(width * r)::INT AS fit_width, trunc(height * r)::INT AS fit_height, round(width / greatest(height, 1), 8) AS aspect, round(width::DOUBLE * height / 1e6, 8) AS megapixels FROM (SELECT DISTINCT id, width, height, least(1200 / width, 1200 / height, 1e0) AS r FROM images WHERE width > 0 AND height > 0)"
ORACLES["image_keys"] = "SELECT DISTINCT id, left(md5(doc_id || '_' || checksum), 16) AS key, '2025/05/01/' || left(checksum, 8) || '.' || lower(format) AS path FROM images"
ORACLES["image_checksums"] = "SELECT DISTINCT id, md5(data) = checksum AS fits, CASE WHEN hex(data) LIKE 'FFD8%' THEN 'jpeg' WHEN hex(data) LIKE '89504E47%' THEN 'png' WHEN hex(data) LIKE '474946%' THEN 'gif' ELSE 'unknown' END AS format FROM images"

_tasks = "(SELECT DISTINCT task_id, document_id, status, progress, created_at, started_at, completed_at FROM tasks)"
ORACLES["task_list"] = f"SELECT task_id, document_id, created_at FROM {_tasks} WHERE status = 'completed' ORDER BY created_at DESC, task_id LIMIT 50"
ORACLES["task_counts"] = f"SELECT status, count(*) AS n, round(avg((epoch_us(completed_at) - epoch_us(started_at)) / 1e6), 4) AS mean_seconds, count(*) FILTER (WHERE completed_at < TIMESTAMP '{NOW}' - INTERVAL 24 HOURS) AS expired FROM {_tasks} GROUP BY status"
ORACLES["task_eta"] = f"SELECT task_id, round(CASE WHEN progress <= 0 OR progress >= 100 THEN 0e0 ELSE s * 100 / progress - s END, 3) AS eta FROM (SELECT task_id, progress, (epoch_us(TIMESTAMP '{NOW}') - epoch_us(started_at)) / 1e6 AS s FROM {_tasks} WHERE started_at IS NOT NULL)"
ORACLES["task_facts"] = f"SELECT task_id, document_id, status, coalesce(pages, 0) AS pages, coalesce(blocks, 0) AS blocks FROM {_tasks} LEFT JOIN (SELECT doc_id, count(DISTINCT page_number) AS pages, count(DISTINCT block_uid) AS blocks FROM text_blocks GROUP BY doc_id) ON document_id = doc_id"
ORACLES["error_stats"] = "SELECT event_type, count(*) AS n, count(*) FILTER (WHERE ts BETWEEN TIMESTAMP '2024-01-14 00:00:00' AND TIMESTAMP '2024-01-15 00:00:00') AS last_day FROM events GROUP BY event_type"
ORACLES["rate_fixed_window"] = "SELECT user_id AS client, epoch_us(ts) // 3600000000 * 3600 AS window_start, count(*) AS n, greatest(count(*) - 2, 0) AS refused FROM events GROUP BY ALL"
ORACLES["rate_layered_windows"] = """WITH w AS (SELECT user_id AS client, width, most, epoch_us(ts) // (width * 1000000::BIGINT) AS k, count(*) AS n FROM events, (VALUES (60, 60), (3600, 1000), (86400, 10000)) l(width, most) GROUP BY ALL)
SELECT client, width, count(*) AS windows, max(n) AS most, sum(greatest(n - w.most, 0))::BIGINT AS refused FROM w GROUP BY client, width"""
ORACLES["rate_rolling_budget"] = "SELECT event_id, count(*) OVER w AS used_requests, round(sum(value) OVER w, 4) AS used_cost FROM events WINDOW w AS (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW)"
ORACLES["rate_rule_match"] = """SELECT method, path, rule, most, count(*) AS n FROM (SELECT CASE event_type WHEN 'view' THEN 'GET' ELSE 'POST' END AS method, CASE event_type WHEN 'purchase' THEN '/api/upload/file' WHEN 'view' THEN '/api/status' ELSE '/other' END AS path,
 CASE event_type WHEN 'purchase' THEN 'uploads' WHEN 'view' THEN 'views' ELSE 'any' END AS rule, CASE event_type WHEN 'purchase' THEN 5 WHEN 'view' THEN 60 ELSE 100 END AS most FROM events) GROUP BY ALL"""
ORACLES["client_keys"] = "SELECT left(sha256(CASE WHEN user_id % 2 = 0 THEN '10.0.' || (user_id % 256) || '.1' ELSE user_id::VARCHAR END), 16) AS client, count(*) AS n FROM events GROUP BY 1"
ORACLES["bench_summary"] = "SELECT event_type, count(value) AS n, round(min(value), 8) AS low, round(max(value), 8) AS high, round(avg(value), 8) AS mean, round(coalesce(stddev_samp(value), 0), 8) AS spread FROM events GROUP BY event_type"

_D = "d AS (SELECT DISTINCT doc_id, page_number, id, bbox.x AS x, bbox.y AS y, bbox.w AS w, bbox.h AS h FROM images WHERE bbox IS NOT NULL), n AS (SELECT a.doc_id, a.page_number, a.id AS a, b.id AS b FROM d a JOIN d b USING (doc_id, page_number) WHERE a.id <> b.id AND (a.x + a.w / 2 - b.x - b.w / 2) ** 2 + (a.y + a.h / 2 - b.y - b.h / 2) ** 2 <= 62500)"
_C = f"{_D}, r(doc_id, page_number, a, b) AS (SELECT doc_id, page_number, id, id FROM d UNION SELECT r.doc_id, r.page_number, r.a, n.b FROM r JOIN n ON n.a = r.b AND n.doc_id = r.doc_id AND n.page_number = r.page_number), c AS (SELECT doc_id, page_number, a AS id, min(b) AS component FROM r GROUP BY ALL)"
ORACLES["drawing_components"] = f"WITH RECURSIVE {_C} SELECT * FROM c"
ORACLES["drawing_figures"] = f"WITH RECURSIVE {_C}, g AS (SELECT doc_id, page_number, component, count(*) AS n, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM c JOIN d USING (doc_id, page_number, id) GROUP BY ALL) SELECT doc_id, page_number, component, n, round(x, 8) AS x, round(y, 8) AS y, round(w, 8) AS w, round(h, 8) AS h FROM g WHERE n >= 2 AND w * h >= 5000"
ORACLES["drawing_stars"] = f"WITH {_D} SELECT doc_id, page_number, id, least(id, coalesce(b, id)) AS hub FROM d LEFT JOIN (SELECT a AS id, min(b) AS b FROM n GROUP BY a) USING (id)"
ORACLES["page_reading_order"] = f"WITH {E} SELECT doc_id, page_number, kind, element, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY y, x, element) AS place FROM e"
