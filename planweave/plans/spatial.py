"""Texts of dimensions, angles, intervals, rings, scales, solids and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from planweave.functions import geometry as G
from planweave.functions import openings as O
from planweave.functions import text as T
from planweave.operators.intervals import band_pairs, dedupe_walls, greedy_pairs, merge_collinear, overlapping_pairs, with_neighbour
from planweave.operators.scale import chosen_scale, fallback_scale, rank_matched_scale, scale_from_area, scale_from_rooms
from planweave.operators.vector import InvertedIndex, cosine_top_k
from planweave.sources.tables import table


def sanitize_key(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url")
    return pages.select("page_id", T.safe_name(F.col("url")).alias("name"), T.first_page_key(F.col("url")).alias("first_page"))


def parse_dimensions(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_size")
    text = F.format_string("ROOM %d'%d\" x %d'%d\"", "p_size", (F.col("p_partkey") % 12).cast("int"), (F.col("p_size") % 17 + 3), (F.col("p_partkey") % 11).cast("int"))
    d = T.room_dimension(text)
    return part.select("p_partkey", F.round(d["width_m"], 6).alias("width_m"), F.round(d["height_m"], 6).alias("height_m"), F.round(d["area_m2"], 6).alias("area_m2"))


def parse_sqft_ceiling(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey", "p_size")
    sqft = F.when(F.col("p_partkey") % 2 == 0, F.format_string("Unit SQFT %d", "p_partkey")).otherwise(F.format_string("%d sq ft unit", "p_partkey"))
    ceiling = F.format_string("CEILING HEIGHT %d'%d\"", F.col("p_size") % 12 + 5, (F.col("p_partkey") % 12).cast("int"))
    return part.select("p_partkey", T.square_feet(sqft).alias("sqft"), F.round(T.square_feet(sqft) * T.SQUARE_METERS_PER_SQUARE_FOOT, 4).alias("area_m2"), T.ceiling_height(ceiling).alias("ceiling_m"))


def classify_type(spark: SparkSession, folder: str) -> DataFrame:
    """The first room type that a whole text names."""
    return table(spark, folder, "documents").select("doc_id", T.room_type(F.col("text")).alias("room_type"))


def hex_rgba(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part").select("p_partkey")
    color = F.when(F.col("p_partkey") % 7 == 0, F.lit("#FFF")).otherwise(F.concat(F.lit("#"), F.lpad(F.hex(F.pmod(F.col("p_partkey") * 4099, F.lit(1 << 24))), 6, "0")))
    c = T.rgba(color)
    return part.select("p_partkey", *[c[i].alias(n) for i, n in enumerate("rgba")])


def line_angles(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey", (F.col("l_quantity") - 25).cast("int").alias("dx"), ((F.col("l_partkey") % 41) - 20).cast("int").alias("dy")).distinct()
    return lines.withColumn("angle", G.angle(F.col("dx"), F.col("dy")))


def angle_class(spark: SparkSession, folder: str) -> DataFrame:
    a = line_angles(spark, folder)
    return a.select("l_orderkey", "l_partkey", "dx", "dy", F.round("angle", 6).alias("angle"), G.orientation(F.col("angle")).alias("orientation"))


def order_lines(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of each order as intervals: id is their place in a full order of columns."""
    order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")
    # named before they move, so that what follows finds a plan's lines together
    li = table(spark, folder, "lineitem").select(F.col("l_orderkey").alias("plan"), *order)
    w = Window.partitionBy("plan").orderBy(*order)
    q = F.col("l_quantity").cast("int")
    return li.select("plan", F.row_number().over(w).cast("long").alias("id"), q.alias("pos"), (q % 9).alias("s"), (q % 9 + 5 * F.col("l_linenumber")).cast("int").alias("e"), (F.col("l_partkey") % 20).cast("int").alias("thick"))


ORDER_LINES = """
    WITH o AS (SELECT l_orderkey AS plan, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS id,
      l_quantity::INT AS pos, l_quantity::INT % 9 AS s, l_quantity::INT % 9 + 5 * l_linenumber AS e, (l_partkey % 20)::INT AS thick FROM lineitem)"""


def overlap_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of an order with their overlap where it is at least 0.3."""
    pairs = overlapping_pairs(order_lines(spark, folder), ["plan"], "id", "s", "e", 16)
    ratio = G.overlap_ratio(F.col("s_a"), F.col("e_a"), F.col("s_b"), F.col("e_b"))
    return pairs.select("plan", "a", "b", F.round(ratio, 6).alias("overlap")).filter("overlap >= 0.3")


def q_band_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return band_pairs(order_lines(spark, folder), ["plan"], "pos", "id", 3, 8)


def near_exists(spark: SparkSession, folder: str) -> DataFrame:
    """Lines with another one of the order nearby in position and start: a semi-join."""
    o = order_lines(spark, folder).select("plan", "id", "pos", "s")
    near = (F.col("id") != F.col("id_b")) & ((F.col("pos") - F.col("pos_b")) ** 2 + (F.col("s") - F.col("s_b")) ** 2 < 36)
    return with_neighbour(o, ["plan"], "pos", 6, near, "left_semi").select("plan", "id")


def not_covered(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that no earlier line of the order overlaps by more than 0.3 of the longer within 15: an anti-join."""
    o = order_lines(spark, folder).select("plan", "id", "pos", "s", "e")
    covered = (F.col("id_b") < F.col("id")) & (F.abs(F.col("pos") - F.col("pos_b")) < 15) & (G.overlap_ratio(F.col("s"), F.col("e"), F.col("s_b"), F.col("e_b")) > 0.3)
    return with_neighbour(o, ["plan"], "pos", 15, covered, "left_anti").select("plan", "id")


def q_greedy_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return greedy_pairs(order_lines(spark, folder), ["plan"], 3, 20, 0.3)


def q_merge_collinear(spark: SparkSession, folder: str) -> DataFrame:
    return merge_collinear(order_lines(spark, folder), ["plan"], 2, 10)


def q_dedupe_walls(spark: SparkSession, folder: str) -> DataFrame:
    return dedupe_walls(order_lines(spark, folder), ["plan"], 10, 0.4)


def rings(spark: SparkSession, folder: str) -> DataFrame:
    """Orders of three lines or more as rings of points in line order."""
    o = order_lines(spark, folder).select("plan", F.struct("id", F.col("pos").alias("x"), F.col("thick").alias("y")).alias("p"))
    points = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return o.groupBy("plan").agg(points.alias("ring")).filter(F.size("ring") >= 3)


def shoelace_area(spark: SparkSession, folder: str) -> DataFrame:
    return rings(spark, folder).select("plan", F.round(G.ring_area(F.col("ring")), 6).alias("area"))


def centroids(spark: SparkSession, folder: str) -> DataFrame:
    c = G.centroid(F.col("ring"))
    return rings(spark, folder).select("plan", F.round(c["x"], 6).alias("cx"), F.round(c["y"], 6).alias("cy"))


def px_to_world(spark: SparkSession, folder: str) -> DataFrame:
    """Points in metres about each ring's box, at 40 pixels to the metre."""
    r = rings(spark, folder).select("plan", "ring", F.array_min("ring.x").alias("min_x"), F.array_max("ring.y").alias("max_y"))
    points = r.select("plan", "min_x", "max_y", F.posexplode("ring").alias("i", "p"))
    m = G.to_meters(F.col("p.x"), F.col("p.y"), F.col("min_x"), F.col("max_y"), F.lit(40.0))
    return points.select("plan", "i", m["x"].alias("x"), m["y"].alias("y"))


def mesh_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Vertices and faces of the rings drawn up to three metres."""
    mesh = G.extruded(F.col("ring"), F.lit(0.0), F.lit(3.0))
    return rings(spark, folder).select("plan", mesh.alias("mesh")).select("plan", F.size("mesh.vertices").alias("vertices"), F.size("mesh.faces").alias("faces"))


def rank_zip_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Per nation, suppliers and customers matched by rank of balance; the median of the roots of their ratios."""
    drawn = table(spark, folder, "customer").filter("c_acctbal > 0").select(F.col("c_nationkey").alias("nation"), "c_custkey", "c_acctbal")
    real = table(spark, folder, "supplier").filter("s_acctbal > 0").select(F.col("s_nationkey").alias("nation"), "s_suppkey", "s_acctbal")
    s = rank_matched_scale(drawn, real, ["nation"], "c_acctbal", "s_acctbal", ("c_custkey", "s_suppkey"))
    return s.select("nation", F.round("px_per_meter", 6).alias("px_per_meter"), F.round("confidence", 4).alias("confidence"))


def boxes(spark: SparkSession, folder: str) -> DataFrame:
    """Per order a box and the sum of its lines' areas."""
    o = order_lines(spark, folder)
    return o.groupBy("plan").agg(F.sum(F.col("thick") * (F.col("e") - F.col("s"))).alias("area"), (F.max("e") - F.min("s")).alias("w"), (F.max("pos") - F.min("pos") + 1).alias("h"))


def scale_fallback(spark: SparkSession, folder: str) -> DataFrame:
    side = F.greatest("w", "h")
    return boxes(spark, folder).select("plan", F.round(fallback_scale(F.col("area"), side), 6).alias("px_per_meter"))


def scale_select(spark: SparkSession, folder: str) -> DataFrame:
    """The text's scale where there is a plausible floor area, else that of the drawn rooms with its lower confidence."""
    b = boxes(spark, folder)
    known = F.when(F.col("plan") % 3 == 0, F.col("area"))
    text = scale_from_area(known, F.col("w"), F.col("h"))
    text = F.when(known > 50, text)
    rooms = scale_from_rooms(F.col("area"), F.col("w"), F.col("h"), F.lit(None).cast("double"))
    chosen = chosen_scale(text, F.when(text.isNotNull(), 0.65).otherwise(0.0), rooms["px_per_meter"], rooms["confidence"])
    return b.select("plan", F.round(chosen["px_per_meter"], 6).alias("px_per_meter"), chosen["confidence"].alias("confidence"), (chosen["confidence"] < 0.5).alias("scale_uncertain"))


def wall_thickness(spark: SparkSession, folder: str) -> DataFrame:
    o = order_lines(spark, folder).select("plan", "id", F.when(F.col("thick") > 0, F.col("thick")).alias("px"))
    return o.select("plan", "id", F.round(G.wall_thickness(F.col("px"), F.lit(40.0)), 6).alias("meters"))


def deskew_angles(spark: SparkSession, folder: str) -> DataFrame:
    """Per order the median of its segments' angles folded about the axes, and the turn that straightens it."""
    a = line_angles(spark, folder).groupBy("l_orderkey").agg(O.skew(F.round(F.median(O.deskew(F.col("angle"))), 4)).alias("skew"))
    return a.select(F.col("l_orderkey").alias("plan"), "skew", O.rotation(F.col("skew")).alias("turn"))


def window_openings(spark: SparkSession, folder: str) -> DataFrame:
    """Rings whose first two points touch the left or upper edge, and the scale that fits them to a canvas."""
    r = rings(spark, folder)
    fit = O.canvas_scale(F.array_max("ring.x") * 30, F.array_max("ring.y") * 30)
    return r.select("plan", O.on_edge(F.col("ring")).alias("is_window"), F.round(fit, 6).alias("fit"))


def fidelity_score(spark: SparkSession, folder: str) -> DataFrame:
    """Per customer the mean relative error of line prices against order prices, as accuracy and weighted score."""
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("measured"))
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    error = F.abs(F.col("measured") - F.col("o_totalprice")) / F.col("o_totalprice")
    mean = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).filter("o_totalprice > 0").groupBy("o_custkey").agg(F.avg(error).alias("mean"))
    accuracy = O.area_accuracy(F.col("mean"))
    return mean.select("o_custkey", F.round(accuracy, 4).alias("room_area_accuracy"), O.fidelity(accuracy).alias("overall"))


def cosine_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The five vectors most similar to each whose id is divisible by 100, themselves among them."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    top = cosine_top_k(v, v.filter("vec_id % 100 = 0"), 5)
    return top.select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))


def indexed_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The same through an inverted-file index, searched until nothing nearer can be left."""
    v = table(spark, folder, "embeddings").select("vec_id", "embedding")
    top = InvertedIndex(v).search(v.filter("vec_id % 100 = 0"), 5)
    return top.select("query_id", "vec_id", "rank", F.round("similarity", 4).alias("similarity"))


QUERIES = {
    "sanitize_key": sanitize_key,
    "parse_dimensions": parse_dimensions,
    "parse_sqft_ceiling": parse_sqft_ceiling,
    "classify_type": classify_type,
    "hex_rgba": hex_rgba,
    "angle_class": angle_class,
    "overlap_ratio": overlap_pairs,
    "band_pairs": q_band_pairs,
    "near_exists": near_exists,
    "not_covered": not_covered,
    "greedy_pairs": q_greedy_pairs,
    "merge_collinear": q_merge_collinear,
    "dedupe_walls": q_dedupe_walls,
    "shoelace_area": shoelace_area,
    "centroid": centroids,
    "px_to_world": px_to_world,
    "mesh_counts": mesh_counts,
    "rank_zip_scale": rank_zip_scale,
    "scale_fallback": scale_fallback,
    "scale_select": scale_select,
    "wall_thickness": wall_thickness,
    "deskew_angles": deskew_angles,
    "window_openings": window_openings,
    "fidelity_score": fidelity_score,
    "cosine_topk": cosine_topk,
    "indexed_topk": indexed_topk,
}

_ROOM = "CASE " + " ".join(
    "WHEN " + " OR ".join([" AND ".join(f"contains(t, '{p}')" for p in ((part,) if isinstance(part, str) else part)) for part in parts] + [f"t = '{w}'" for w in whole]) + f" THEN '{name}'" for name, parts, whole in T.ROOM_TYPES
) + " ELSE 'unknown' END"
_OVERLAP = "greatest(0, least(a.e, b.e) - greatest(a.s, b.s)) / greatest(a.e - a.s, b.e - b.s, 1)::DOUBLE"
_RINGS = ORDER_LINES + ", r AS (SELECT plan, id, pos AS x, thick AS y, count(*) OVER (PARTITION BY plan) AS n FROM o), q AS (SELECT * FROM r WHERE n >= 3)"
_BOXES = ORDER_LINES + ", b AS (SELECT plan, sum(thick * (e - s)) AS area, max(e) - min(s) AS w, max(pos) - min(pos) + 1 AS h FROM o GROUP BY plan)"
_FALLBACK = "CASE WHEN area < 1 THEN greatest(w, h) / 20.0::DOUBLE ELSE least(greatest(w, h) / 20.0::DOUBLE, sqrt(area / 20.0::DOUBLE)) END"



def _fold(order: str, state: str, hit: str, step: str, result: str) -> str:
    """One line of a plan at a time by a recursive query; ``x`` is the line and ``st`` the state before it."""
    return f"""
        WITH RECURSIVE {ORDER_LINES.strip().removeprefix("WITH ")},
        l AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY {order}) AS k, count(*) OVER (PARTITION BY plan) AS n FROM o),
        f AS (SELECT DISTINCT plan, 0::BIGINT AS k, n, {state} AS st FROM l UNION ALL
          SELECT plan, k, n, {step} FROM (SELECT f.plan, l.k, f.n, f.st, l.id, l.pos, l.s, l.e, l.thick, {hit} AS hit FROM f JOIN l ON f.plan = l.plan AND l.k = f.k + 1)),
        r AS (SELECT plan, st FROM f WHERE k = n)
        {result}"""


_SHARE = "greatest(0, least(o.e, l.e) - greatest(o.s, l.s)) / greatest(o.e - o.s, l.e - l.s, 1)::DOUBLE"



def greedy_sql(result: str) -> str:
    """The pairs of each plan as ``st.pairs`` of the table r, and what is made of them."""
    return _fold(
        "pos, id, s, e",
        "{'open': []::STRUCT(pos INT, id BIGINT, s INT, e INT)[], 'pairs': []::STRUCT(a BIGINT, b BIGINT, apart INT)[]}",
        f"list_filter(f.st.open, lambda o: l.pos - o.pos BETWEEN 3 AND 20 AND {_SHARE} >= 0.3)[1]",
        """CASE WHEN hit IS NULL THEN {'open': list_append(st.open, {'pos': pos, 'id': id, 's': s, 'e': e}), 'pairs': st.pairs}
             ELSE {'open': list_filter(st.open, lambda o: o.id <> hit.id), 'pairs': list_append(st.pairs, {'a': hit.id, 'b': id, 'apart': pos - hit.pos})} END""",
        result,
    )


ORACLE_SQL = {
    "greedy_pairs": greedy_sql("SELECT plan, p.a, p.b, p.apart FROM (SELECT plan, unnest(st.pairs) AS p FROM r)"),
    "merge_collinear": _fold(
        "id",
        "[]::STRUCT(pos INT, s INT, e INT, n INT)[]",
        "list_position(list_transform(f.st, lambda o: abs(o.pos - l.pos) <= 10 AND greatest(o.s, l.s) - least(o.e, l.e) <= 2), true)",
        """CASE WHEN hit IS NULL THEN list_append(st, {'pos': pos, 's': s, 'e': e, 'n': 1})
             ELSE list_transform(st, lambda o, i: CASE WHEN i = hit THEN {'pos': trunc((o.pos + pos) / 2.0)::INT, 's': least(o.s, s), 'e': greatest(o.e, e), 'n': o.n + 1} ELSE o END) END""",
        "SELECT plan, (i - 1)::INT AS extent, x.pos, x.s, x.e, x.n FROM (SELECT plan, unnest(st) AS x, unnest(range(1, len(st) + 1)) AS i FROM r)",
    ),
    "dedupe_walls": _fold(
        "id",
        "[]::STRUCT(id BIGINT, pos INT, s INT, e INT, best BIGINT, thick INT)[]",
        f"list_position(list_transform(f.st, lambda o: abs(o.pos - l.pos) <= 10 AND {_SHARE} > 0.4), true)",
        """CASE WHEN hit IS NULL THEN list_append(st, {'id': id, 'pos': pos, 's': s, 'e': e, 'best': id, 'thick': thick})
             ELSE list_transform(st, lambda o, i: CASE WHEN i = hit AND thick > o.thick THEN {'id': o.id, 'pos': o.pos, 's': o.s, 'e': o.e, 'best': id, 'thick': thick} ELSE o END) END""",
        "SELECT plan, x.id AS seed, x.best AS kept, x.thick FROM (SELECT plan, unnest(st) AS x FROM r)",
    ),
    "sanitize_key": r"""
        SELECT page_id, substr(regexp_replace(url, '[^\p{L}\p{N}._-]', '_', 'g'), 1, 64) AS name, regexp_replace(url, '\.[^.]*$', '') || '_page1.png' AS first_page FROM pages""",
    "parse_dimensions": """
        WITH d AS (SELECT p_partkey, (p_size * 12 + p_partkey % 12) * 0.0254::DOUBLE AS w, ((p_size % 17 + 3) * 12 + p_partkey % 11) * 0.0254::DOUBLE AS h FROM part),
        k AS (SELECT *, w > 1 AND w < 25 AND h > 1 AND h < 25 AS ok FROM d)
        SELECT p_partkey, CASE WHEN ok THEN round(w, 6) END AS width_m, CASE WHEN ok THEN round(h, 6) END AS height_m, CASE WHEN ok THEN round(w * h, 6) END AS area_m2 FROM k""",
    "parse_sqft_ceiling": """
        WITH d AS (SELECT p_partkey, CASE WHEN p_partkey > 50 AND p_partkey < 50000 THEN p_partkey::INT END AS v, ((p_size % 12 + 5) * 12 + p_partkey % 12) * 0.0254::DOUBLE AS c FROM part)
        SELECT p_partkey, v AS sqft, round(v * 0.0929::DOUBLE, 4) AS area_m2, CASE WHEN c > 2 AND c < 6 THEN round(c, 2) END AS ceiling_m FROM d""",
    "classify_type": f"SELECT doc_id, {_ROOM} AS room_type FROM (SELECT doc_id, lower(regexp_replace(text, '^[\\t-\\r\\x1C-\\x20\\x85\\xA0]+|[\\t-\\r\\x1C-\\x20\\x85\\xA0]+$', '', 'g')) AS t FROM documents)",
    "hex_rgba": """
        SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 200 ELSE (p_partkey * 4099 // 65536 % 256)::INT END AS r, CASE WHEN p_partkey % 7 = 0 THEN 200 ELSE (p_partkey * 4099 // 256 % 256)::INT END AS g,
          CASE WHEN p_partkey % 7 = 0 THEN 200 ELSE (p_partkey * 4099 % 256)::INT END AS b, 255 AS a FROM part""",
    "angle_class": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, (l_quantity - 25)::INT AS dx, (l_partkey % 41 - 20)::INT AS dy FROM lineitem),
        a AS (SELECT *, fmod(fmod(degrees(atan2(dy, dx)), 180) + 180, 180) AS g FROM l)
        SELECT l_orderkey, l_partkey, dx, dy, round(g, 6) AS angle, CASE WHEN g < 3 OR g > 177 THEN 'horizontal' WHEN abs(g - 90) < 3 THEN 'vertical' END AS orientation FROM a""",
    "overlap_ratio": ORDER_LINES + f" SELECT a.plan, a.id AS a, b.id AS b, round({_OVERLAP}, 6) AS overlap FROM o a JOIN o b ON a.plan = b.plan AND a.id < b.id WHERE round({_OVERLAP}, 6) >= 0.3",
    "band_pairs": ORDER_LINES + " SELECT a.plan, a.id AS a, b.id AS b, b.pos - a.pos AS apart FROM o a JOIN o b ON a.plan = b.plan AND b.pos - a.pos BETWEEN 3 AND 8",
    "near_exists": ORDER_LINES + " SELECT plan, id FROM o a WHERE EXISTS (SELECT 1 FROM o b WHERE a.plan = b.plan AND a.id <> b.id AND (a.pos - b.pos) ** 2 + (a.s - b.s) ** 2 < 36)",
    "not_covered": ORDER_LINES + f" SELECT plan, id FROM o a WHERE NOT EXISTS (SELECT 1 FROM o b WHERE a.plan = b.plan AND b.id < a.id AND abs(a.pos - b.pos) < 15 AND {_OVERLAP} > 0.3)",
    "shoelace_area": _RINGS + """
        , c AS (SELECT plan, x, y, coalesce(lead(x) OVER w, first(x) OVER w) AS x2, coalesce(lead(y) OVER w, first(y) OVER w) AS y2 FROM q WINDOW w AS (PARTITION BY plan ORDER BY id))
        SELECT plan, round(abs(sum(x * y2 - x2 * y)) / 2.0::DOUBLE, 6) AS area FROM c GROUP BY plan""",
    "centroid": _RINGS + " SELECT plan, round(avg(x), 6) AS cx, round(avg(y), 6) AS cy FROM q GROUP BY plan",
    "px_to_world": _RINGS + """
        SELECT plan, (row_number() OVER (PARTITION BY plan ORDER BY id) - 1)::INT AS i, (x - min(x) OVER (PARTITION BY plan)) / 40.0::DOUBLE AS x, (max(y) OVER (PARTITION BY plan) - y) / 40.0::DOUBLE AS y FROM q""",
    "mesh_counts": _RINGS + " SELECT plan, (2 * count(*))::INT AS vertices, (4 * count(*) - 4)::INT AS faces FROM q GROUP BY plan",
    "rank_zip_scale": """
        WITH a AS (SELECT c_nationkey AS nation, c_acctbal AS v, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) AS k FROM customer WHERE c_acctbal > 0),
        b AS (SELECT s_nationkey AS nation, s_acctbal AS u, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS k FROM supplier WHERE s_acctbal > 0)
        SELECT nation, round(median(sqrt(v / u)), 6) AS px_per_meter, round(least(0.8, 0.5 + 0.1 * count(*))::DOUBLE, 4) AS confidence FROM a JOIN b USING (nation, k) GROUP BY nation""",
    "scale_fallback": _BOXES + f" SELECT plan, round({_FALLBACK}, 6) AS px_per_meter FROM b",
    "scale_select": _BOXES + """
        , t AS (SELECT *, CASE WHEN plan % 3 = 0 AND area > 50 THEN sqrt(0.7::DOUBLE * w * h / (area * 0.0929::DOUBLE)) END AS text, CASE WHEN area < 100 THEN w * h * 0.6::DOUBLE ELSE area END AS drawn FROM b),
        r AS (SELECT *, sqrt(drawn / greatest(drawn * (15.0::DOUBLE / greatest(w, h)) ** 2, 20)) AS rooms FROM t)
        SELECT plan, round(coalesce(text, CASE WHEN drawn > 0 THEN rooms ELSE 50 END), 6)::DOUBLE AS px_per_meter, CASE WHEN text IS NOT NULL THEN 0.65 WHEN drawn > 0 THEN 0.35 ELSE 0.1 END::DOUBLE AS confidence, text IS NULL AS scale_uncertain FROM r""",
    "wall_thickness": ORDER_LINES + " SELECT plan, id, round(CASE WHEN thick > 0 THEN least(greatest(thick / 40.0::DOUBLE, 0.05), 0.8) ELSE 0.15 END, 6)::DOUBLE AS meters FROM o",
    "deskew_angles": """
        WITH l AS (SELECT DISTINCT l_orderkey, l_partkey, (l_quantity - 25)::INT AS dx, (l_partkey % 41 - 20)::INT AS dy FROM lineitem),
        a AS (SELECT *, fmod(fmod(degrees(atan2(dy, dx)), 180) + 180, 180) AS g FROM l),
        m AS (SELECT l_orderkey AS plan, round(median(CASE WHEN g > 135 THEN g - 180 WHEN g > 45 THEN g - 90 ELSE g END), 4) AS middle FROM a GROUP BY l_orderkey)
        SELECT plan, CASE WHEN abs(middle) < 0.3 THEN 0.0 ELSE middle END AS skew, CASE WHEN abs(middle) > 0.5 THEN -middle ELSE 0.0 END AS turn FROM m""",
    "window_openings": _RINGS + """
        , p AS (SELECT *, row_number() OVER (PARTITION BY plan ORDER BY id) AS k FROM q)
        SELECT plan, bool_or(k <= 2 AND (x <= 5 OR y <= 5)) AS is_window,
          round(least(700 / CASE WHEN max(x) = 0 THEN 800 ELSE max(x) * 30 END::DOUBLE, 700 / CASE WHEN max(y) = 0 THEN 600 ELSE max(y) * 30 END::DOUBLE, 1.0), 6)::DOUBLE AS fit FROM p GROUP BY plan""",
    "fidelity_score": """
        WITH l AS (SELECT l_orderkey, sum(l_extendedprice) AS measured FROM lineitem GROUP BY l_orderkey),
        m AS (SELECT o_custkey, 1.0::DOUBLE - least(avg(abs(measured - o_totalprice) / o_totalprice), 1.0) AS a FROM orders JOIN l ON o_orderkey = l_orderkey WHERE o_totalprice > 0 GROUP BY o_custkey)
        SELECT o_custkey, round(a, 4) AS room_area_accuracy, round(0.4::DOUBLE + 0.3::DOUBLE * a + 0.2::DOUBLE + 0.1::DOUBLE, 4) AS overall FROM m""",
    "cosine_topk": """
        WITH p AS (SELECT q.vec_id AS query_id, v.vec_id, list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[]) AS s FROM embeddings q JOIN embeddings v ON q.vec_id % 100 = 0),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id)::INT AS rank FROM p)
        SELECT query_id, vec_id, rank, round(s, 4) AS similarity FROM r WHERE rank <= 5""",
}
ORACLE_SQL["indexed_topk"] = ORACLE_SQL["cosine_topk"]
