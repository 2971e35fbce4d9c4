"""Queries on boxes, plans, context and planning."""

from pyspark.sql import functions as F

from hushframe.functions import geometry as g
from hushframe.functions.text import goal_score, terms
from hushframe.operators import context, folds, layers, loop, metrics, planner, snapshot, spatial
from hushframe.plans.inputs import AREA, BOXES_SQL, boxes, cover, inter, iou, table, union
from hushframe.sources.corpus import dom_blind

QUERIES, ORACLE_SQL = {}, {}
B = f"b AS ({BOXES_SQL})"


def query(sql=None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


@query(f"""WITH {B} SELECT a.page_id, a.ord AS ord_a, b2.ord AS ord_b, {inter('a', 'b2')} AS inter, {union('a', 'b2')} AS uni
           FROM b a JOIN b b2 ON a.page_id = b2.page_id AND a.ord < b2.ord WHERE {inter('a', 'b2')} > 0""")
def box_iou_pairs(spark, d):
    b = boxes(spark, d)
    p = spatial.overlapping_pairs(b, b).where("ord_a < ord_b")
    i, u = g.intersection(F.col("box_a"), F.col("box_b")), g.union(F.col("box_a"), F.col("box_b"))
    return p.select("page_id", "ord_a", "ord_b", i.alias("inter"), u.alias("uni"))


@query(f"""WITH {B} SELECT a.page_id, a.ord, max({cover('a', 'p')}) AS most
           FROM b a JOIN b p ON a.page_id = p.page_id WHERE a.side = 'O' AND p.side = 'F' GROUP BY ALL""")
def box_coverage(spark, d):
    b = boxes(spark, d)
    masks = b.where("side = 'F'").select("page_id", F.col("box").alias("m"))
    return b.where("side = 'O'").join(masks, "page_id").groupBy("page_id", "ord").agg(F.max(g.coverage(F.col("box"), F.col("m"))).alias("most"))


@query(f"""WITH {B} SELECT page_id, ord FROM b o WHERE EXISTS (SELECT 1 FROM b i WHERE i.page_id = o.page_id AND i.ord <> o.ord
           AND i.x1 >= o.x1 - 2 AND i.y1 >= o.y1 - 2 AND i.x2 <= o.x2 + 2 AND i.y2 <= o.y2 + 2)""")
def container_boxes(spark, d):
    return spatial.containers(boxes(spark, d)).select("page_id", "ord")


def _masked(negate, threshold=0.5):
    return f"""WITH {B} SELECT page_id, ord FROM b e WHERE side = 'O' AND {negate} EXISTS
           (SELECT 1 FROM b p WHERE p.page_id = e.page_id AND p.side = 'F' AND {cover('e', 'p')} > {threshold})"""


@query(_masked(""))
def masked_semi(spark, d):
    b = boxes(spark, d)
    return spatial.covered(b.where("side = 'O'"), b.where("side = 'F'")).select("page_id", "ord")


@query(_masked("NOT"))
def masked_anti(spark, d):
    b = boxes(spark, d)
    return spatial.uncovered(b.where("side = 'O'"), b.where("side = 'F'")).select("page_id", "ord")


@query(_masked("NOT", 0.8))
def unmasked_images(spark, d):
    b = boxes(spark, d)
    return spatial.uncovered(b.where("side = 'O'"), b.where("side = 'F'"), 0.8).select("page_id", "ord")


@query(f"""WITH {B} SELECT page_id, ord FROM b e WHERE side = 'O' AND NOT EXISTS (SELECT 1 FROM b p
           WHERE p.page_id = e.page_id AND p.side = 'F' AND p.x1 = e.x1 AND p.y1 = e.y1 AND p.x2 = e.x2 AND p.y2 = e.y2)""")
def uncovered_exact(spark, d):
    b = boxes(spark, d)
    return spatial.not_exactly_covered(b.where("side = 'O'"), b.where("side = 'F'")).select("page_id", "ord")


@query(f"""WITH {B}, j AS (SELECT e.page_id, e.ord, min(p.ord) AS f FROM b e JOIN b p ON p.page_id = e.page_id AND p.side = 'F'
           AND {iou('e', 'p')} > 0.4 WHERE e.side = 'O' GROUP BY ALL)
           SELECT e.page_id, e.ord, coalesce(p.score, 0.0) AS confidence FROM b e LEFT JOIN j ON j.page_id = e.page_id AND j.ord = e.ord
           LEFT JOIN b p ON p.page_id = j.page_id AND p.ord = j.f WHERE e.side = 'O'""")
def detector_agreement(spark, d):
    b = boxes(spark, d)
    return spatial.first_agreement(b.where("side = 'O'"), b.where("side = 'F'")).select("page_id", "ord", "confidence")


@query(f"""WITH {B}, pt AS (SELECT page_id, ord, (x1 + x2) / 2 AS x, (y1 + y2) / 2 AS y FROM b WHERE side = 'O')
           SELECT pt.page_id, pt.ord, arg_min(e.ord, struct_pack(a := {AREA.format(a='e')}, o := e.ord)) AS hit
           FROM pt LEFT JOIN b e ON e.page_id = pt.page_id AND e.x1 <= pt.x AND pt.x < e.x2 AND e.y1 <= pt.y AND pt.y < e.y2
           GROUP BY ALL""")
def element_at_point(spark, d):
    b = boxes(spark, d)
    points = b.where("side = 'O'").select("page_id", "ord", g.centre(F.col("box")).alias("c")).select("page_id", "ord", "c.x", "c.y")
    hits = spatial.at_point(points.withColumnRenamed("ord", "pt"), b)
    return hits.select("page_id", F.col("pt").alias("ord"), "hit")


def _fold(order, keep, where=""):
    """Kept ords of each page by a fold over its boxes in the given order."""
    return f"""WITH {B}, l AS (SELECT page_id, list({{'ord': ord, 'cls': cls, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY {order}) AS bs FROM b {where} GROUP BY page_id),
    k AS (SELECT page_id, list_reduce(list_transform(bs, lambda x: [x]), lambda a, e: CASE WHEN
          len(list_filter(a, lambda k: {keep})) > 0 THEN a ELSE list_concat(a, e) END) AS kept FROM l)
    SELECT page_id, CAST(len(kept) AS INT) AS n, CAST(list_sum(list_transform(kept, lambda x: x.ord)) AS BIGINT) AS ords FROM k"""


_K = lambda s: s.replace("q.", "k.").replace("e.", "e[1].")


@query(_fold("score DESC, ord", f"{_K(iou('q', 'e'))} >= 0.45"))
def nms_boxes(spark, d):
    pages = folds.by_page(boxes(spark, d), "page_id", "items", "score", "ord", "cls", "box")
    kept = folds.suppress(F.col("items"))
    return pages.select("page_id", F.size(kept).alias("n"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x["ord"]).alias("ords"))


@query(_fold("score DESC, ord", f"k.cls = e[1].cls AND {_K(iou('q', 'e'))} >= 0.45"))
def nms_boxes_by_class(spark, d):
    pages = folds.by_page(boxes(spark, d), "page_id", "items", "score", "ord", "cls", "box")
    kept = folds.suppress(F.col("items"), per_class=True)
    return pages.select("page_id", F.size(kept).alias("n"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x["ord"]).alias("ords"))


@query(_fold("CASE cls WHEN 'AADHAAR' THEN 1 WHEN 'ADDRESS' THEN 2 ELSE 5 END, ord", f"{_K(iou('q', 'e'))} > 0.55"))
def plan_dedupe(spark, d):
    b = boxes(spark, d).withColumn("rank", folds.priority(F.col("cls")))
    kept = folds.dedupe_plan(F.col("items"))
    return folds.by_page(b, "page_id", "items", "rank", "ord", "cls", "box").select(
        "page_id", F.size(kept).alias("n"), F.aggregate(kept, F.lit(0).cast("bigint"), lambda a, x: a + x["ord"]).alias("ords")
    )


_SPANS = f"""WITH {B}, s AS (SELECT page_id, side, list({{'ord': ord, 'cls': cls, 's': x1, 'e': x2}} ORDER BY ord) AS l FROM b GROUP BY ALL),
    j AS (SELECT p.page_id, coalesce(g.l, []) AS gs, coalesce(r.l, []) AS ps FROM (SELECT DISTINCT page_id FROM b) p
          LEFT JOIN s g ON g.page_id = p.page_id AND g.side = 'O' LEFT JOIN s r ON r.page_id = p.page_id AND r.side = 'F'),
    f AS (SELECT page_id, gs, ps, list_reduce(list_prepend([CAST(0 AS INT)], list_transform(gs, lambda x: [x.ord])), lambda a, x: list_append(a,
          coalesce(list_filter(ps, lambda p: p.cls = list_filter(gs, lambda q: q.ord = x[1])[1].cls
             AND p.s < list_filter(gs, lambda q: q.ord = x[1])[1].e AND list_filter(gs, lambda q: q.ord = x[1])[1].s < p.e
             AND NOT list_contains(a, p.ord))[1].ord, -1))) AS used FROM j)
    SELECT page_id, CAST(len(list_filter(used, lambda u: u > 0)) AS BIGINT) AS tp,
           CAST(len(ps) - len(list_filter(used, lambda u: u > 0)) AS BIGINT) AS fp,
           CAST(len(gs) - len(list_filter(used, lambda u: u > 0)) AS BIGINT) AS fn FROM f"""


@query(_SPANS)
def greedy_match_text(spark, d):
    b = boxes(spark, d).select("page_id", "side", "ord", "cls", F.col("box.x1").alias("start"), F.col("box.x2").alias("end"))
    both = b.groupBy("page_id").agg(
        *(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("ord", "cls", "start", "end")))).alias(n) for s, n in (("O", "gold"), ("F", "predicted")))
    )
    hit = F.size(F.filter(folds.first_fit(F.col("gold"), F.col("predicted")), lambda u: u > 0)).cast("bigint")
    return both.select("page_id", hit.alias("tp"), (F.size("predicted") - hit).alias("fp"), (F.size("gold") - hit).alias("fn"))


def _taken(order):
    """By page the gold boxes that each prediction could take, best first, in order of the predictions."""
    return f"""WITH {B}, c AS (SELECT p.page_id, p.score, p.ord, list(g.ord ORDER BY -{iou('p', 'g')}, g.ord) AS fits FROM b p JOIN b g ON g.page_id = p.page_id
      AND g.side = 'O' AND p.side = 'F' AND g.cls = p.cls AND {iou('p', 'g')} >= 0.5 GROUP BY ALL),
   l AS (SELECT page_id, list(fits ORDER BY {order}) AS ps FROM c GROUP BY page_id),
   u AS (SELECT page_id, list_reduce(list_prepend([CAST(0 AS INT)], ps), lambda a, x: list_append(a, coalesce(list_filter(x, lambda o: NOT list_contains(a, o))[1], -1))) AS used FROM l),
   t AS (SELECT page_id, CAST(len(list_filter(used, lambda o: o > 0)) AS BIGINT) AS tp FROM u)
   SELECT n.page_id, coalesce(tp, 0) AS tp, CAST(p - coalesce(tp, 0) AS BIGINT) AS fp, CAST(g - coalesce(tp, 0) AS BIGINT) AS fn
   FROM (SELECT page_id, count_if(side = 'F') AS p, count_if(side = 'O') AS g FROM b GROUP BY page_id) n LEFT JOIN t USING (page_id)"""


def _matched_boxes(spark, d, by_score):
    b = boxes(spark, d)
    both = b.groupBy("page_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "O", F.struct("ord", "cls", "box")))).alias("gold"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "F", F.struct("score", "ord", "cls", "box")))).alias("predicted"),
    )
    hit = F.size(F.filter(folds.best_overlap(F.col("predicted"), F.col("gold"), by_score=by_score), lambda u: u > 0)).cast("bigint")
    return both.select("page_id", hit.alias("tp"), (F.size("predicted") - hit).alias("fp"), (F.size("gold") - hit).alias("fn"))


@query(_taken("score DESC, ord"))
def greedy_match_boxes(spark, d):
    return _matched_boxes(spark, d, True)


@query(_taken("ord"))
def greedy_match_plan(spark, d):
    return _matched_boxes(spark, d, False)


def _px(where):
    return f"""SELECT page_id, sum(CAST(dx AS BIGINT) * dy) AS px FROM (SELECT x.page_id, x.v AS x1, x.w - x.v AS dx, y.v AS y1, y.w - y.v AS dy
      FROM xs x JOIN ys y USING (page_id) WHERE x.w IS NOT NULL AND y.w IS NOT NULL AND EXISTS
      (SELECT 1 FROM c WHERE c.page_id = x.page_id AND ({where}) AND c.x1 <= x.v AND x.w <= c.x2 AND c.y1 <= y.v AND y.w <= c.y2)) GROUP BY page_id"""


@query(f"""WITH {B}, c AS (SELECT page_id, side, least(x1, 1280) x1, least(x2, 1280) x2, least(y1, 720) y1, least(y2, 720) y2 FROM b),
  xs AS (SELECT page_id, v, lead(v) OVER (PARTITION BY page_id ORDER BY v) w FROM (SELECT page_id, x1 v FROM c UNION SELECT page_id, x2 FROM c)),
  ys AS (SELECT page_id, v, lead(v) OVER (PARTITION BY page_id ORDER BY v) w FROM (SELECT page_id, y1 v FROM c UNION SELECT page_id, y2 FROM c)),
  m AS ({_px("side = 'F'")}), s AS ({_px("side = 'O'")}), e AS ({_px("true")})
  SELECT e.page_id, CAST(coalesce(m.px, 0) AS BIGINT) AS mask_px, CAST(coalesce(s.px, 0) AS BIGINT) AS sensitive_px, CAST(e.px AS BIGINT) AS either_px,
         CAST(coalesce(m.px, 0) + coalesce(s.px, 0) - e.px AS BIGINT) AS both_px FROM e LEFT JOIN m USING (page_id) LEFT JOIN s USING (page_id)""")
def union_area(spark, d):
    pages = boxes(spark, d).groupBy("page_id").agg(
        F.collect_list(F.when(F.col("side") == "F", F.col("box"))).alias("masks"), F.collect_list(F.when(F.col("side") == "O", F.col("box"))).alias("sensitive")
    )
    return metrics.masked_pixels(pages, 1280, 720)


@query(f"""WITH {B}, t AS (SELECT page_id, x1, y1, x2, y2 FROM b WHERE ord = 1) SELECT e.page_id, e.ord FROM b e WHERE ord > 1 AND EXISTS
          (SELECT 1 FROM t WHERE t.page_id = e.page_id AND greatest(0, greatest(t.y1, e.y1) - least(t.y2, e.y2)) <= 120
           AND least(t.x2, e.x2) - greatest(t.x1, e.x1) > 0)""")
def nearby_context(spark, d):
    b = boxes(spark, d)
    return spatial.nearby(b.where("ord > 1"), b.where("ord = 1")).select("page_id", "ord")


_STOP = "['the','a','an','my','our','for','to','of','in','on','and','or','please','can','you','i','me','with','from','this','that']"


def duck_terms(c):
    return f"list_filter(string_split_regex(lower({c}), '[^a-z0-9]+'), lambda t: length(t) > 2 AND NOT list_contains({_STOP}, t))"


def duck_hits(goal, words):
    return f"len(list_filter({goal}, lambda gg: len(list_filter({words}, lambda w: starts_with(w, gg) OR starts_with(gg, w))) > 0))"


GOAL = "Please download my income certificate"
_SCORED = f"""WITH {B}, gg AS (SELECT {duck_terms(f"'{GOAL}'")} AS gt), j AS (SELECT e.page_id, e.ord, min(p.ord) AS f FROM b e JOIN b p ON p.page_id = e.page_id
    AND p.side = 'F' AND {iou('e', 'p')} > 0.4 GROUP BY ALL),
  sc AS (SELECT e.*, CAST({duck_hits('gt', duck_terms("e.label || ' '"))} AS DOUBLE) / len(gt) AS u, e.role <> 'text' AS act, coalesce(p.score, 0.0) AS conf,
         EXISTS (SELECT 1 FROM b s WHERE s.page_id = e.page_id AND s.cls = 'AADHAAR' AND {cover('e', 's')} > 0.5) AS sens
    FROM gg, b e LEFT JOIN j ON j.page_id = e.page_id AND j.ord = e.ord LEFT JOIN b p ON p.page_id = j.page_id AND p.ord = j.f),
  r AS (SELECT *, u * 1.2::DOUBLE + CAST(act AS INT) * 0.25::DOUBLE + conf * 0.2::DOUBLE - CAST(sens AS INT) * 0.8::DOUBLE AS score2 FROM sc)"""


def _scored(spark, d):
    b = boxes(spark, d).withColumn("text", F.lit(""))
    goals = b.select("page_id").distinct().withColumn("goal", F.lit(GOAL))
    return context.scored_regions(b.drop("score"), goals, b.where("side = 'F'"), b.where("cls = 'AADHAAR'"))


@query(_SCORED + " SELECT page_id, ord, u AS relevance, act AS actionable, conf AS confidence, sens AS sensitive, score2 AS score FROM r")
def region_scores(spark, d):
    return _scored(spark, d).select("page_id", "ord", "relevance", "actionable", "confidence", "sensitive", "score")


_KEEP = """, dir AS (SELECT * FROM r WHERE u > 0 AND NOT sens), kp AS (SELECT * FROM dir UNION ALL SELECT * FROM r e WHERE u = 0 AND NOT sens AND NOT act AND EXISTS
    (SELECT 1 FROM dir t WHERE t.page_id = e.page_id AND greatest(0, greatest(t.y1, e.y1) - least(t.y2, e.y2)) <= 120 AND least(t.x2, e.x2) - greatest(t.x1, e.x1) > 0)),
  cr AS (SELECT page_id, count(*) AS kept, greatest(0, min(x1) - 24) x1, greatest(0, min(y1) - 24) y1, least(1280, max(x2) + 24) x2, least(720, max(y2) + 24) y2,
         list(ord ORDER BY ord) AS ids FROM kp GROUP BY page_id),
  sel AS (SELECT n.page_id, n.considered, coalesce(kept, 0) AS kept, CASE WHEN kept IS NULL THEN 'minimal-empty'
          WHEN (x2 - x1) * (y2 - y1) > 0.88::DOUBLE * 921600 THEN 'full-view' ELSE 'task-roi' END AS mode, x1, y1, x2, y2, coalesce(ids, []) AS ids
          FROM (SELECT page_id, count(*) AS considered FROM r GROUP BY page_id) n LEFT JOIN cr USING (page_id)),
  fin AS (SELECT page_id, mode, kept, considered, ids, CASE mode WHEN 'task-roi' THEN x1 ELSE 0 END x1, CASE mode WHEN 'task-roi' THEN y1 ELSE 0 END y1,
          CASE mode WHEN 'minimal-empty' THEN 1 WHEN 'full-view' THEN 1280 ELSE x2 END x2, CASE mode WHEN 'minimal-empty' THEN 1 WHEN 'full-view' THEN 720 ELSE y2 END y2 FROM sel)"""


@query(_SCORED + _KEEP + """ SELECT page_id, mode, kept, considered, x1, y1, x2, y2, array_to_string(ids, ',') AS ids,
    CASE mode WHEN 'full-view' THEN 1.0::DOUBLE ELSE CAST((x2 - x1) * (y2 - y1) AS DOUBLE) / 921600 END AS pixel_fraction FROM fin""")
def crop_selection(spark, d):
    s = context.selected_context(_scored(spark, d), F.lit(1280), F.lit(720))
    return s.select("page_id", "mode", "kept", "considered", "crop.x1", "crop.y1", "crop.x2", "crop.y2", F.array_join("selected_ids", ",").alias("ids"), "pixel_fraction")


@query(_SCORED + _KEEP + """ SELECT page_id, ord, n FROM (SELECT page_id, ord, CAST(row_number() OVER (PARTITION BY page_id ORDER BY score2 DESC, u = 0, ord) AS INT) AS n FROM kp) WHERE n <= 5""")
def top5_regions(spark, d):
    s = context.selected_context(_scored(spark, d), F.lit(1280), F.lit(720))
    return s.select("page_id", F.posexplode("top").alias("at", "x")).select("page_id", "x.ord", (F.col("at") + 1).alias("n"))


@query(_SCORED + _KEEP + f""", ch AS (SELECT e.*, f.x1 AS ox, f.y1 AS oy, row_number() OVER (PARTITION BY e.page_id ORDER BY e.ord) AS n FROM b e JOIN fin f USING (page_id)
    WHERE list_contains(f.ids, e.ord) AND e.role <> 'text' AND e.enabled)
    SELECT e.page_id, 'el_' || e.ord AS id, role, CASE WHEN s THEN '[REDACTED]' ELSE label[1:60] END AS label, e.x1 - ox AS x1, e.y1 - oy AS y1, s AS sensitive, same_origin
    FROM (SELECT e.*, EXISTS (SELECT 1 FROM b p WHERE p.page_id = e.page_id AND p.side = 'F' AND {cover('e', 'p')} > 0.35) AS s FROM ch e WHERE n <= 60) e""")
def safe_metadata(spark, d):
    b = boxes(spark, d).withColumn("text", F.lit(""))
    s = context.selected_context(_scored(spark, d), F.lit(1280), F.lit(720))
    m = context.safe_metadata(b, b.where("side = 'F'"), s)
    return m.select("page_id", "id", "role", "label", "box.x1", "box.y1", "sensitive", "same_origin")


@query(f"""WITH n AS (SELECT n_nationkey AS id, 'Find the ' || n_name || ' ring and red widget please' AS goal FROM nation),
  c AS (SELECT p_partkey % 25 AS id, p_partkey AS ord, 'el_' || p_partkey AS eid, CASE p_size % 5 WHEN 0 THEN 'button' WHEN 1 THEN 'link' WHEN 2 THEN 'textbox' WHEN 3 THEN 'combobox' ELSE 'text' END AS role,
        p_name || ' ' || p_type AS label, p_size % 4 = 0 AS sens, p_size % 3 <> 0 AS same FROM part),
  s AS (SELECT n.id, ord, eid, role, CAST({duck_hits(duck_terms('goal'), duck_terms('label'))} AS DOUBLE) / greatest(1, len({duck_terms('goal')}))
        + CASE WHEN role IN ('button', 'link') THEN 0.15::DOUBLE ELSE 0.0 END AS score
        FROM n JOIN c USING (id) WHERE NOT sens AND same AND role <> 'text' AND len({duck_terms('label')}) > 0),
  t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS k FROM s WHERE score > 0)
  SELECT n.id AS request_id, CASE WHEN coalesce(score, 0) < 0.2 THEN 'STOP' WHEN role = 'textbox' THEN 'TYPE' WHEN role = 'combobox' THEN 'SELECT' ELSE 'CLICK' END AS action,
         CASE WHEN score >= 0.2 THEN eid END AS target_id FROM n LEFT JOIN t ON t.id = n.id AND k = 1""")
def rules_planner(spark, d):
    requests = table(spark, d, "nation").select(F.col("n_nationkey").alias("request_id"), F.concat(F.lit("Find the "), "n_name", F.lit(" ring and red widget please")).alias("goal"))
    p, size = table(spark, d, "part"), F.col("p_size")
    role = F.element_at(F.array(*map(F.lit, ("button", "link", "textbox", "combobox", "text"))), size % 5 + 1)
    e = p.select(
        (F.col("p_partkey") % 25).cast("int").alias("request_id"), F.col("p_partkey").alias("ord"), F.concat(F.lit("el_"), "p_partkey").alias("id"), role.alias("role"),
        F.concat_ws(" ", "p_name", "p_type").alias("label"), (size % 4 == 0).alias("sensitive"), (size % 3 != 0).alias("same_origin"), F.array(F.lit("first")).alias("options"),
    )
    return planner.plan_rules(requests, e).select("request_id", "action", "target_id")


_GATE = f"""SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'CLICK' WHEN 1 THEN 'TYPE' WHEN 2 THEN 'SELECT' WHEN 3 THEN 'SCROLL' WHEN 4 THEN 'WAIT' WHEN 5 THEN 'STOP' WHEN 6 THEN 'DRAG' END AS act,
  c_custkey IS NOT NULL AS found, c_custkey % 7 = 0 AS sens, c_custkey % 5 <> 0 AS same,
  {duck_terms("CASE o_custkey % 4 WHEN 0 THEN 'to the' WHEN 1 THEN 'urgent order form' ELSE 'open priority list' END")} AS gt, {duck_terms("o_orderpriority || ' order button'")} AS tt FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 11 <> 0"""


@query(f"""WITH o AS ({_GATE}), n AS (SELECT *, CASE WHEN len(gt) = 0 THEN 'goal has no actionable terms' WHEN len(tt) = 0 THEN 'target has no safe label'
      WHEN {duck_hits('gt', 'tt')} > 0 THEN 'goal term matches target label' ELSE 'no goal term matches target label' END AS note FROM o),
  v AS (SELECT o_orderkey, CASE WHEN act IS NULL THEN ['BLOCK', 'planner returned no object'] WHEN act = 'DRAG' THEN ['BLOCK', 'unsupported action: DRAG']
      WHEN act IN ('SCROLL', 'WAIT', 'STOP') THEN ['ALLOW', act || ' needs no target'] WHEN NOT found THEN ['BLOCK', 'target_id is outside disclosed metadata']
      WHEN sens THEN ['BLOCK', 'target overlaps a redacted region'] WHEN NOT same THEN ['BLOCK', 'target origin is cross-origin or unresolved']
      WHEN note <> 'goal term matches target label' THEN ['BLOCK', 'intent check: ' || note] WHEN act = 'TYPE' THEN ['CONFIRM', 'state-changing input action']
      ELSE ['ALLOW', 'risk R1'] END AS r FROM n) SELECT o_orderkey, r[1] AS verdict, r[2] AS reason FROM v""")
def action_gate(spark, d):
    o = table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    action = F.get(F.array(*map(F.lit, ("CLICK", "TYPE", "SELECT", "SCROLL", "WAIT", "STOP", "DRAG"))), (k % 8).cast("int"))
    goal = F.when(c % 4 == 0, "to the").when(c % 4 == 1, "urgent order form").otherwise("open priority list")
    note = planner.intent_note(terms(goal), terms(F.concat("o_orderpriority", F.lit(" order button"))))
    # What is disclosed to every request: a customer of eleven is not.
    e = table(spark, d, "customer").where("c_custkey % 11 <> 0").select(
        F.lit(0).alias("request_id"), F.col("c_custkey").alias("id"), F.col("c_custkey").alias("ord"), (F.col("c_custkey") % 7 == 0).alias("sensitive"), (F.col("c_custkey") % 5 != 0).alias("same_origin")
    )
    acts = o.select("o_orderkey", F.lit(0).alias("request_id"), c.alias("target_id"), action.alias("action"), note.alias("note"))
    v = planner.gate(F.col("action"), F.col("found"), F.col("sensitive"), F.col("same_origin"), F.col("note"))
    return planner.with_target(acts, e).select("o_orderkey", v.alias("v")).select("o_orderkey", "v.verdict", "v.reason")


@query(f"""WITH {B} SELECT page_id, ord, '[' || cls || '_' || row_number() OVER (PARTITION BY page_id, cls ORDER BY ord) || ']' AS token FROM b""")
def token_numbering(spark, d):
    return layers.token_numbers(boxes(spark, d).withColumn("place", F.col("ord"))).select("page_id", "ord", "token")


@query(f"""WITH {B} SELECT page_id, ord, CAST(floor(x1 * 1.5::DOUBLE + 0.5) AS INT) AS x1, CAST(floor(y1 * 1.25::DOUBLE + 0.5) AS INT) AS y1,
      CAST(floor(x2 * 1.5::DOUBLE + 0.5) AS INT) AS x2, CAST(floor(y2 * 1.25::DOUBLE + 0.5) AS INT) AS y2 FROM b""")
def scaled_boxes(spark, d):
    return boxes(spark, d).select("page_id", "ord", g.scaled(F.col("box"), F.lit(1.5), F.lit(1.25)).alias("s")).select("page_id", "ord", "s.*")


@query(f"""WITH {B}, m AS (SELECT page_id, cls, side FROM b) SELECT cls, CAST(count_if(side = 'O') AS BIGINT) AS tp, CAST(count_if(side = 'F') AS BIGINT) AS fp, CAST(0 AS BIGINT) AS fn FROM m GROUP BY ROLLUP (cls)""")
def micro_rollup(spark, d):
    b = boxes(spark, d)
    rows = b.select("cls", (F.col("side") == "O").cast("bigint").alias("tp"), (F.col("side") == "F").cast("bigint").alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    return metrics.per_class_and_micro(rows).select("cls", "tp", "fp", "fn")


def _dom_blind(percent):
    return f"""WITH {B} SELECT page_id, ord FROM b WHERE role <> 'link' AND NOT (role = 'text' AND CAST('0x' || md5(page_id || '/' || ord)[1:8] AS BIGINT) % 100 < {percent})"""


def _without_links(spark, d):
    return boxes(spark, d).withColumn("tag", F.when(F.col("role") == "link", "img").otherwise("div"))


@query(_dom_blind(70))
def dom_blind_variant(spark, d):
    return dom_blind(_without_links(spark, d), 70).select("page_id", "ord")


@query(_dom_blind(34))
def dom_blind_hashed(spark, d):
    return dom_blind(_without_links(spark, d)).select("page_id", "ord")


def _layer_inputs(spark, d):
    """Elements, of which every second has a number and every fourth a sentence with two names, and detections: every
    third an image, the others chips with an address in them."""
    b = boxes(spark, d, dealt=True).withColumn("tag", F.lit("div")).withColumn("input_type", F.lit(None).cast("string"))
    pan = F.concat(F.lit("ABCDE"), F.lpad((F.col("page_id") % 10000).cast("string"), 4, "0"), F.lit("F"))
    text = F.when(F.col("ord") % 2 == 0, pan).when(F.col("ord") % 4 == 1, "Handed to Ravi Verma and then to Asha Nair today").otherwise("")
    kind = F.when(F.col("ord") % 3 == 0, "image_region").otherwise("value_chip")
    return b.withColumn("text", text).drop("cls"), b.withColumn("cls", kind).withColumn("ocr_text", F.lit("ravi@example.org"))


_BOX = "x1, y1, x2, y2"
_LAYERS = f"""{B},
   l1 AS (SELECT page_id, ord, 1 AS rank, 'PAN' AS cls, 'blackout' AS mode, 'L1' AS layer, 'dom-label+regex' AS src, CAST(NULL AS VARCHAR) AS span, 0 AS st, {_BOX} FROM b WHERE ord % 2 = 0),
   l2 AS (SELECT page_id, ord, 5 AS rank, 'PERSON' AS cls, 'token' AS mode, 'L2' AS layer, 'heuristic-person' AS src, n.span, n.st, {_BOX} FROM b, (VALUES ('Ravi Verma', 1), ('Asha Nair', 2)) n(span, st)
      WHERE ord % 4 = 1 AND NOT EXISTS (SELECT 1 FROM l1 p WHERE p.page_id = b.page_id AND p.x1 = b.x1 AND p.y1 = b.y1 AND p.x2 = b.x2 AND p.y2 = b.y2)),
   ds AS (SELECT page_id, ord, 5 AS rank, CASE WHEN ord % 3 = 0 THEN 'PHOTO' ELSE 'EMAIL' END AS cls, CASE WHEN ord % 3 = 0 THEN 'blur' ELSE 'token' END AS mode, 'L3' AS layer,
      CASE WHEN ord % 3 = 0 THEN 'vision-image-region' ELSE 'vision-ocr' END AS src, CAST(NULL AS VARCHAR) AS span, 0 AS st, {_BOX} FROM b)"""
#: The plan that stays of ``it``: items of all configurations.
_STAYS = f"""l AS (SELECT config, page_id, list({{'cls': cls, 'mode': mode, 'layer': layer, 'src': src, 'span': span, 'ord': ord, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2}} ORDER BY rank, layer, ord, st) AS bs FROM it GROUP BY ALL),
   k AS (SELECT config, page_id, list_reduce(list_transform(bs, lambda x: [x]), lambda a, e: CASE WHEN len(list_filter(a, lambda k: {_K(iou('q', 'e'))} > 0.55)) > 0 THEN a ELSE list_concat(a, e) END) AS kept FROM l),
   z AS (SELECT config, page_id, CAST(unnest(range(len(kept))) AS INT) AS place, unnest(kept) AS x FROM k)"""


#: Ten words to a text, ten pixels apart in its element's box: what spells a name, or begins to, and where.
_NARROW = "SELECT * REPLACE (x1 + CASE st WHEN 1 THEN 17 ELSE 67 END AS x1, y1 + 2 AS y1, x1 + CASE st WHEN 1 THEN 41 ELSE 81 END AS x2, y1 + 18 AS y2) FROM l2"


@query(f"""WITH {_LAYERS}, it AS (SELECT c.config, i.* FROM (VALUES ('L1', 'L1', false), ('L1+L2', 'L2', false), ('L1+L2+L3', 'L3', false), ('L1+L2+L3+words', 'L3', true)) c(config, last, small)
      JOIN (SELECT *, NULL::BOOLEAN AS small FROM l1 UNION ALL SELECT *, false FROM l2 UNION ALL SELECT *, true FROM ({_NARROW}) UNION ALL SELECT *, NULL FROM ds) i
      ON i.layer <= c.last AND coalesce(i.small = c.small, true)), {_STAYS}
   SELECT config, page_id, place, x.cls AS cls, x.mode AS mode, x.layer AS layer, x.src AS src, x.span AS span, x.ord AS ord, x.x1 AS x1, x.y2 AS y2 FROM z""")
def layer_ablation(spark, d):
    """The plan of each page with one layer, two, all three, and with spans narrowed to their words."""
    e, dets = _layer_inputs(spark, d)
    w = e.select("page_id", "box", F.col("ord").alias("element"), F.posexplode(F.split(F.col("text"), " ")).alias("ord", "text")).where("text <> ''")
    at = lambda name, by: (F.col(f"box.{name}") + by).alias
    word = F.struct(at("x1", F.col("ord") * 10)("x1"), at("y1", 5)("y1"), at("x1", F.col("ord") * 10 + 8)("x2"), at("y1", 15)("y2"))
    plans = layers.ablation(e, dets, w.withColumn("box", word))
    return plans.select("config", "page_id", "place", "cls", "mode", "layer", "src", "span", "ord", F.col("box.x1").alias("x1"), F.col("box.y2").alias("y2"))


@query("""WITH e AS (SELECT vec_id, embedding v, list_max(embedding[5:9]) s FROM embeddings),
  x AS (SELECT vec_id, list_position(v[5:9], s) - 1 AS cls, CAST(s AS DOUBLE) AS score,
    greatest(0.0, least(1280.0, (CAST(v[1] AS DOUBLE) * 1000 + 500 - abs(CAST(v[3] AS DOUBLE)) * 2000 / 2 - 8) / 0.5::DOUBLE))::DOUBLE AS x1,
    greatest(0.0, least(1280.0, (CAST(v[1] AS DOUBLE) * 1000 + 500 + abs(CAST(v[3] AS DOUBLE)) * 2000 / 2 - 8) / 0.5::DOUBLE))::DOUBLE AS x2 FROM e)
  SELECT vec_id, CAST(cls AS INT) AS cls, score, x1, x2, 0.0::DOUBLE AS y1, 720.0::DOUBLE AS y2 FROM x WHERE score >= 0.30 AND x2 - x1 >= 4""")
def onnx_decode(spark, d):
    # Boxes as high as the page, so that only their width can be too small.
    at = lambda i: F.element_at("embedding", i).cast("double")
    v = F.concat(F.array(at(1) * 1000 + 500, F.lit(300.0), F.abs(at(3)) * 2000, F.lit(600.0)), F.transform(F.slice("embedding", 5, 5), lambda x: x.cast("double")))
    a = snapshot.decoded_anchor(v, 5, F.lit(0.5), F.lit(8.0), F.lit(8.0), F.lit(1280), F.lit(720))
    return table(spark, d, "embeddings").select("vec_id", a.alias("a")).where("a IS NOT NULL").select("vec_id", "a.cls", "a.score", "a.box.x1", "a.box.x2", "a.box.y1", "a.box.y2")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN (m < 140) AND r > 1.8 AND r < 7.5 AND h > 28 AND h < 70 THEN 'button' WHEN w > 110 AND h > 110 AND sd < 48 THEN 'image_region'
     WHEN r > 1.6 AND r < 10 AND h > 26 AND h < 72 AND m > 170 THEN CASE WHEN mg > mb + 3 THEN 'status_block' WHEN abs(ce - 0.5) < 0.20 AND di < 120 AND ink > 0.02 AND w < 220 THEN 'button'
     WHEN ink < 0.035 OR di > 135 THEN 'input' ELSE 'value_chip' END END AS cls, count(*) AS n
   FROM (SELECT *, w / h AS r, (mb + mg + mr) / 3 AS m FROM (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CAST(60 + l_partkey % 200 AS DOUBLE) w, CAST(24 + l_suppkey % 120 AS DOUBLE) h, CAST(l_partkey % 256 AS DOUBLE) mb,
     CAST((l_partkey + l_suppkey) % 256 AS DOUBLE) mg, CAST(l_partkey % 256 AS DOUBLE) mr, CAST(l_suppkey % 90 AS DOUBLE) sd, l_linenumber / 100.0::DOUBLE AS ink, l_quantity / 50 AS ce, CAST(100 + l_linenumber * 9 AS DOUBLE) di FROM lineitem))
   GROUP BY ALL""")
def vision_rules(spark, d):
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    dbl = lambda c: c.cast("double")
    f = table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", dbl(60 + p % 200).alias("w"), dbl(24 + s % 120).alias("h"), dbl(p % 256).alias("mean_b"), dbl((p + s) % 256).alias("mean_g"), dbl(p % 256).alias("mean_r"),
        dbl(s % 90).alias("std"), (n / 100.0).alias("ink"), (F.col("l_quantity") / 50).alias("centroid"), dbl(100 + n * 9).alias("dark_ink"),
    )
    return f.groupBy("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", snapshot.ui_class().alias("cls")).agg(F.count("*").alias("n"))


@query(f"""SELECT p_partkey, CAST({duck_hits(duck_terms("'small ring of my red bolts'"), duck_terms("p_name || ' ' || p_type"))} AS DOUBLE) / len({duck_terms("'small ring of my red bolts'")}) AS score FROM part""")
def goal_scores(spark, d):
    return table(spark, d, "part").select("p_partkey", goal_score(terms(F.lit("small ring of my red bolts")), terms(F.concat_ws(" ", "p_name", "p_type"))).alias("score"))


@query(f"""WITH {_LAYERS}, p AS (SELECT * FROM l1 UNION ALL SELECT * FROM l2),
   s AS (SELECT d.* REPLACE (CASE WHEN cls = 'EMAIL' THEN 'vision-ocr-escalated' ELSE src END AS src) FROM ds d
      WHERE CASE WHEN cls = 'PHOTO' THEN NOT EXISTS (SELECT 1 FROM b i WHERE i.page_id = d.page_id AND i.ord <> d.ord AND i.x1 >= d.x1 - 2 AND i.y1 >= d.y1 - 2 AND i.x2 <= d.x2 + 2 AND i.y2 <= d.y2 + 2)
         AND NOT EXISTS (SELECT 1 FROM p WHERE p.page_id = d.page_id AND {cover('d', 'p')} > 0.8)
      ELSE NOT EXISTS (SELECT 1 FROM b t WHERE t.page_id = d.page_id AND t.ord % 4 <> 3 AND {cover('d', 't')} > 0.5) END),
   it AS (SELECT '' AS config, * FROM p UNION ALL SELECT '', * FROM s), {_STAYS}
   SELECT page_id, place, x.cls AS cls, x.mode AS mode, x.layer AS layer, x.src AS src, x.span AS span, x.ord AS ord FROM z""")
def selective_plan(spark, d):
    """All layers over made-up elements and detections, selectively: structure first, pixels where it is blind."""
    e, dets = _layer_inputs(spark, d)
    return layers.build_plan(e, dets, selective=True).select("page_id", "place", "cls", "mode", "layer", "src", "span", "ord")


_LOOP = f"""{B}, k AS (SELECT *, CASE WHEN role = 'textbox' AND ord % 2 = 0 THEN 'password' END AS kind FROM b),
   s AS (SELECT *, role IN ('button', 'link', 'textbox') AND kind IS NULL AND NOT EXISTS (SELECT 1 FROM b p WHERE p.page_id = k.page_id AND p.side = 'F' AND {cover('k', 'p')} > 0.5) AS shown FROM k),
   t AS (SELECT page_id, min(ord) AS ord FROM b WHERE role = 'button' AND starts_with(label, 'Download') GROUP BY page_id)"""


@query(f"""WITH {_LOOP}, a AS (SELECT DISTINCT page_id FROM b),
   r AS (SELECT a.page_id, t.ord IS NOT NULL AND EXISTS (SELECT 1 FROM s WHERE s.page_id = a.page_id AND s.ord = t.ord AND shown)
                AND NOT EXISTS (SELECT 1 FROM s WHERE s.page_id = a.page_id AND s.ord < t.ord AND shown AND starts_with(label, 'Download') AND role IN ('button', 'link')) AS ok,
          (SELECT count(*) FROM b g WHERE g.page_id = a.page_id AND g.side = 'F' AND
              ((g.cls = 'PERSON' AND (t.ord IS NOT NULL OR EXISTS (SELECT 1 FROM s WHERE s.page_id = a.page_id AND shown AND contains(label, 'income'))))
              OR (g.cls = 'ADDRESS' AND EXISTS (SELECT 1 FROM s WHERE s.page_id = a.page_id AND shown AND label = 'Help')))) AS leaks,
          (SELECT count(*) FROM k WHERE k.page_id = a.page_id AND kind IS NOT NULL AND side = 'O') AS found, (SELECT count(*) FROM k WHERE k.page_id = a.page_id AND kind IS NOT NULL) AS there
        FROM a LEFT JOIN t USING (page_id))
   SELECT CAST(page_id % 2 AS BIGINT) AS set, count(*) AS pages, CAST(sum(CAST(ok AS INT)) AS DOUBLE) / count(*) AS planning_success, CAST(sum(leaks) AS BIGINT) AS pii_strings_in_metadata,
          CAST(sum(found) AS BIGINT) AS secret_fields_found, CAST(sum(there) AS BIGINT) AS secret_fields_expected FROM r GROUP BY ALL""")
def loop_score(spark, d):
    """From pages to scores: what is disclosed, whether the planner clicks the right control, and what leaks."""
    b = boxes(spark, d).withColumn("text", F.col("label"))
    e = b.withColumn("input_type", F.when((F.col("role") == "textbox") & (F.col("ord") % 2 == 0), "password"))
    masks = b.where("side = 'F'")
    secret = F.col("input_type").isNotNull()
    fields = e.groupBy("page_id").agg(F.count_if(secret & (F.col("side") == "O")).alias("secrets_found"), F.count_if(secret).alias("secrets_expected"))
    pages = loop.disclosures(e, masks).join(fields, "page_id").withColumn("set", F.col("page_id") % 2)
    gold = masks.select("page_id", F.when(F.col("cls") == "PERSON", "income").when(F.col("cls") == "ADDRESS", "Help").when(F.col("ord") == 1, "").alias("text"))
    return loop.loop_scores(pages, gold, "set")


_OVER = ORACLE_SQL["union_area"]


@query(f"""SELECT CAST(page_id % 3 AS BIGINT) AS set, count(*) AS pages, CAST(sum(mask_px - both_px) AS BIGINT) AS over_px, CAST(sum(mask_px - both_px) * 100 AS DOUBLE) / (count(*) * 921600) AS overmask_pct
   FROM ({_OVER}) GROUP BY ALL""")
def overmasking(spark, d):
    b = boxes(spark, d)
    of = lambda side: F.collect_list(F.when(F.col("side") == side, F.col("box")))
    pages = b.groupBy("page_id").agg(of("F").alias("masks"), of("O").alias("sensitive")).withColumn("set", F.col("page_id") % 3)
    return loop.overmasked(pages, "set", 1280, 720)


@query(f"WITH {B}, f AS (SELECT DISTINCT page_id FROM b ORDER BY page_id LIMIT 8) SELECT page_id, count(*) AS n FROM b WHERE page_id IN (SELECT page_id FROM f) GROUP BY page_id")
def first_pages(spark, d):
    """The first pages, as many as latencies are measured on."""
    return loop.first_pages(boxes(spark, d), 8).groupBy("page_id").agg(F.count("*").alias("n"))


@query(f"""WITH {B} SELECT page_id, ord, CAST(floor(x1 / 1.5::DOUBLE + 0.5) AS INT) AS x1, CAST(floor(y1 / 1.25::DOUBLE + 0.5) AS INT) AS y1, CAST(floor(x2 / 1.5::DOUBLE + 0.5) AS INT) AS x2,
   CAST(floor(y2 / 1.25::DOUBLE + 0.5) AS INT) AS y2 FROM b""")
def unscaled_boxes(spark, d):
    return boxes(spark, d).select("page_id", "ord", g.unscaled(F.col("box"), F.lit(1.5), F.lit(1.25)).alias("s")).select("page_id", "ord", "s.*")


#: Sentences by the slots that they need, and by customer four of six values.
_SENTENCES = [("Mail {EMAIL} or call {PHONE}.", ["EMAIL", "PHONE"]), ("To {EMAIL}.", ["EMAIL"]), ("{PERSON} lives at {ADDRESS}.", ["PERSON", "ADDRESS"]), ("Pay {ACCOUNT} at {IFSC}, {PERSON}.", ["ACCOUNT", "IFSC", "PERSON"]), ("Dear {PERSON}.", ["PERSON"])]
_SLOTS = ["EMAIL", "PHONE", "PERSON", "ADDRESS", "ACCOUNT", "IFSC"]
_HAS = "(c_custkey >> {k}) % 4 > 0"


@query(f"""WITH c AS (SELECT c_custkey, list_filter([{', '.join(f"CASE WHEN {_HAS.format(k=k)} THEN {{'s': '{s}', 'v': '{s.lower()}' || c_custkey}} END" for k, s in enumerate(_SLOTS))}], lambda x: x IS NOT NULL) AS vs,
       CAST(c_custkey % 5 AS INT) AS turn FROM customer),
   k AS (SELECT *, list_transform(vs, lambda x: x.s) AS known, list_transform(range(5), lambda i: ([{', '.join(f"{{'t': '{t}', 's': {s}}}" for t, s in _SENTENCES)}])[(i + turn) % 5 + 1]) AS ts FROM c),
   f AS (SELECT *, list_reduce(list_transform(ts, lambda x: {{'lines': [x.t], 'used': x.s}}), lambda a, x: CASE WHEN list_has_all(known, x.used) AND NOT list_has_all(a.used, x.used) AND len(a.used) < len(known)
          THEN {{'lines': list_concat(a.lines, x.lines), 'used': list_concat(a.used, list_filter(x.used, lambda u: NOT list_contains(a.used, u)))}} ELSE a END, {{'lines': []::VARCHAR[], 'used': []::VARCHAR[]}}) AS r FROM k)
   SELECT c_custkey, list_reduce(list_prepend({{'s': '', 'v': array_to_string(r.lines, ' ')}}, vs), lambda a, x: {{'s': '', 'v': replace(a.v, '{{' || x.s || '}}', x.v)}}).v AS text,
          array_to_string(list_sort(list_filter(known, lambda s: NOT list_contains(r.used, s))), ',') AS rest FROM f""")
def template_fill(spark, d):
    """Sentences that a customer's values fill, from a place that turns with the customer, and the values that none took."""
    k = F.col("c_custkey")
    has = [F.when(F.expr(_HAS.format(k=i).replace(f"c_custkey >> {i}", f"shiftright(c_custkey, {i})")), F.struct(F.lit(s).alias("s"), F.concat(F.lit(s.lower()), k.cast("string")).alias("v"))) for i, s in enumerate(_SLOTS)]
    values = F.map_from_entries(F.array_compact(F.array(*has)))
    all_ = F.array(*(F.struct(F.lit(t).alias("text"), F.array(*map(F.lit, s)).alias("slots")) for t, s in _SENTENCES))
    turned = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.get(all_, ((i + k) % 5).cast("int")))
    done = folds.filled_templates(turned, values)
    return table(spark, d, "customer").select("c_custkey", done.alias("f")).select("c_custkey", F.array_join("f.lines", " ").alias("text"), F.array_join("f.left", ",").alias("rest"))
