"""Registered queries of the graph engine and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfabric.config import HealSettings
from wayfabric.functions import pixels as px
from wayfabric.functions import stencil
from wayfabric.operators import ablation, graph, heal, metrics, paths, raster, skeleton, tiles
from wayfabric.operators.components import components
from wayfabric.plans import export
from wayfabric.scratch import materialize
from wayfabric.sources import fixtures as fx

FLAGSHIP = "stress_test"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Healing settings of the fixture graph; the library's defaults leave too few candidates there.
FIXTURE_HEAL = HealSettings(max_gap=80.0, max_angle=60.0)
DENSE, SPARSE = 0.0, 0.15


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its DuckDB equivalent if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def r6(c: str, places: int = 6):
    return F.round(c, places).alias(c)


# ---- projections of the test tables, in SQL -------------------------------------------------

NODES = """geo_nodes as materialized (select vec_id as node_id,
  cast(round(600+1500*cast(embedding[1] as double)) as int) as x,
  cast(round(600+1500*cast(embedding[2] as double)) as int) as y from embeddings)"""
EDGES = """geo_edges as materialized (select a.node_id as a, b.node_id as b,
  sqrt(cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double)) as length,
  cast(round(1000*sqrt(cast((a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) as double))) as bigint) as w
  from geo_nodes a join geo_nodes b on a.node_id<b.node_id and (a.x-b.x)*(a.x-b.x)+(a.y-b.y)*(a.y-b.y) between 1 and 900)"""
SYM = "sym as materialized (select a, b, w from geo_edges union all select b, a, w from geo_edges)"
GRAPH = f"{NODES}, {EDGES}, {SYM}"
CELL = """cell as materialized (select cast(vec_id as int) as y, cast(i-1 as int) as x, cast(embedding[i] as double) as v
  from (select vec_id, embedding, unnest(range(1,65)) i from embeddings))"""
META = "meta as (select cast(max(vec_id)+1 as int) as h, 64 as w from embeddings)"
GT = "gt as materialized (select y, x from cell where v>0.10)"
PRED = "pred as materialized (select y, cast((x+1)%64 as int) as x from cell where v>0.12)"


def comp(nodes: str = "select node_id, node_id from geo_nodes", sym: str = "sym", name: str = "comp") -> str:
    return f"""{name}(k, v) using key (k) as ({nodes} union
  select e.b, min(c.v) from {name} c join {sym} e on e.a=c.k join recurring.{name} old on old.k=e.b where c.v<old.v group by e.b)"""


def offsets(pairs: list[tuple[int, int]], name: str = "off") -> str:
    return f"{name}(dy, dx) as (values {', '.join(f'({dy},{dx})' for dy, dx in pairs)})"


EIGHT = offsets(stencil.NEIGHBOURS, "eight")
LCC = f"""{comp()}, sizes as (select v, count(*) n from comp group by v),
core as materialized (select k as node_id from comp where v=(select v from sizes order by n desc, v limit 1)),
core_sym as materialized (select s.* from sym s join core c on s.a=c.node_id)"""


# ---- pixel rules ----------------------------------------------------------------------------

IMG = """img as materialized (select vec_id as y, i-1 as x,
  cast(floor(least(255.0e0,greatest(0.0e0,128+300*cast(embedding[i] as double)))) as int) as r,
  cast(floor(least(255.0e0,greatest(0.0e0,128+300*cast(embedding[i%64+1] as double)))) as int) as g,
  cast(floor(least(255.0e0,greatest(0.0e0,128+300*cast(embedding[(i+1)%64+1] as double)))) as int) as b
  from (select vec_id, embedding, unnest(range(1,65)) i from embeddings))"""
ROAD = """((greatest(r,g,b)-least(r,g,b)<25 and r+g+b>270 and r+g+b<705) or least(r,g,b)>230 or (r>220 and g>140 and g<215 and b<130))
  and not (g>r+12 and g>b+12 and g>120) and not (r+g+b<180)"""
BANDS = """bands as materialized (select vec_id as y, i-1 as x, cast(floor(1000*(cast(embedding[i] as double)+0.5e0)) as int) as red,
  cast(floor(1000*(cast(embedding[i%64+1] as double)+0.5e0)) as int) as nir
  from (select vec_id, embedding, unnest(range(1,65)) i from embeddings))"""


@query(f"with {IMG} select cast(y as int) as y, cast(x as int) as x, r, g, b from img where {ROAD}")
def mask_colormap_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of a road colour."""
    return fx.image(spark, sf_dir).where(px.is_road_colour(F.col("r"), F.col("g"), F.col("b"))).select("y", "x", "r", "g", "b")


@query(f"with {IMG}, l as (select cast(round(0.299e0*r+0.587e0*g+0.114e0*b) as int) as gray from img) select count(distinct gray) as tones, count(distinct gray)<=6 as two_tone from l")
def two_tone_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the image has few gray levels."""
    return px.two_tone(fx.image(spark, sf_dir)).select("tones", "two_tone")


@query(f"""with {IMG}, l as (select *, cast(round(0.299e0*r+0.587e0*g+0.114e0*b) as int) as gray, {ROAD} as colour from img),
s as (select count(distinct gray)<=6 or avg(cast(colour as int))<0.01 as by_gray, avg(cast(gray>127 as int))<=0.5 as bright from l)
select cast(y as int) as y, cast(x as int) as x from l, s where case when by_gray then (gray>127)=bright else colour end""")  # fmt: skip
def road_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mask after the choice between the colour rule and the gray threshold."""
    return px.road_mask(fx.image(spark, sf_dir)).select("y", "x")


@query(f"""with {IMG}, l as (select y, x, cast(floor(r/128)*200 as int) as gray from img), s as (select avg(cast(gray>127 as int))<=0.5 as bright from l)
select cast(y as int) as y, cast(x as int) as x from l, s where (gray>127)=bright""")  # fmt: skip
def threshold_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gray threshold of a two-tone image, in the polarity that marks fewer pixels."""
    tone = (F.floor(F.col("r") / 128) * 200).cast("int")
    flat = fx.image(spark, sf_dir).select("img_id", "y", "x", tone.alias("r"), tone.alias("g"), tone.alias("b"))
    return px.road_mask(flat).select("y", "x")


@query(f"""with {CELL}, p as (select quantile_cont(v, 0.02) lo, quantile_cont(v, 0.98) hi0 from cell), q as (select lo, case when hi0<=lo then lo+1 else hi0 end hi from p)
select y, x, cast(floor(greatest(0.0e0, least(1.0e0, (v-lo)/(hi-lo)))*255) as int) as byte from cell, q""")  # fmt: skip
def band_stretch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentile stretch of a band to bytes."""
    return px.stretch(fx.cells(spark, sf_dir)).select("y", "x", "byte")


@query(f"""with {BANDS}, n as (select y, x, cast(nir-red as double)/case when nir+red=0 then 1e-6 else cast(nir+red as double) end as ndvi from bands)
select cast(y as int) as y, cast(x as int) as x, round(ndvi, 6) as ndvi from n where ndvi>0.3""")  # fmt: skip
def ndvi_vegetation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vegetation pixels."""
    rows = fx.bands(spark, sf_dir).withColumn("ndvi", px.ndvi(F.col("red"), F.col("nir")))
    return rows.where(px.is_vegetation(F.col("ndvi"))).select("y", "x", r6("ndvi"))


@query(f"with {NODES} select node_id, 100+0.5e0*(2*x+0.5e0)+0.1e0*(2*y+0.5e0) as cx, 900+0.2e0*(2*x+0.5e0)-0.5e0*(2*y+0.5e0) as cy from geo_nodes")
def pixel_to_crs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixel centres in the coordinates of an affine transform, at half the original size."""
    cx, cy = px.to_crs(F.col("x"), F.col("y"), (0.5, 0.1, 100.0, 0.2, -0.5, 900.0), (2.0, 2.0))
    return fx.geo_nodes(spark, sf_dir).select("node_id", cx.alias("cx"), cy.alias("cy"))


_SHAPES = ", ".join(f"('{kind}', {cx}, {cy}, {rx}, {ry})" for _, kind, cx, cy, rx, ry in fx.SHAPES)
OCC = f"""shapes(kind, cx, cy, rx, ry) as (values {_SHAPES}),
occ as materialized (select y, x from gt where not exists (select 1 from shapes s where case when kind='disc'
  then (x-cx)*(x-cx)+(y-cy)*(y-cy)<=rx*rx else abs(x-cx)<=rx and abs(y-cy)<=ry end))"""


@query(f"with {CELL}, {GT}, {OCC} select y, x from occ")
def occlusion_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth pixels that no occluding shape covers."""
    return raster.occlude(fx.foreground(spark, sf_dir, 0.10), fx.shapes(spark)).select("y", "x")


@query(f"with {CELL}, {GT}, {OCC} select y, x from gt except select y, x from occ")
def occluded_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Truth pixels that the shapes took away."""
    truth = fx.foreground(spark, sf_dir, 0.10)
    return raster.occluded_region(truth, raster.occlude(truth, fx.shapes(spark))).select("y", "x")


# ---- stencils and skeleton ------------------------------------------------------------------

PIX = f"{CELL}, pix as materialized (select y, x from cell where v>{SPARSE}), {EIGHT}, cnt as materialized (select p.y, p.x, count(q.y) as n from pix p cross join eight left join pix q on q.y=p.y+dy and q.x=p.x+dx group by p.y, p.x)"


@query(f"with {PIX} select y, x, cast(n as int) as n from cnt")
def neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Foreground neighbours of each foreground pixel."""
    return stencil.neighbour_count(fx.foreground(spark, sf_dir, SPARSE)).select("y", "x", "n")


@query(f"with {PIX} select row_number() over (order by y, x)-1 as node_id, y, x, cast(n as int) as n from cnt where n=1 or n>=3")
def node_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End points and junctions, numbered in scan order."""
    return skeleton.node_pixels(fx.foreground(spark, sf_dir, SPARSE)).select("node_id", "y", "x", "n")


_FIVE, _NINE = offsets(stencil.ellipse(5), "k"), offsets(stencil.ellipse(9), "nine")
_DIL = f"{CELL}, {META}, src as materialized (select y, x from cell where v>0.2), {_FIVE}, dil as materialized (select distinct y+dy as y, x+dx as x from src, k, meta where y+dy between 0 and h-1 and x+dx between 0 and w-1)"


@query(f"with {_DIL} select cast(y as int) as y, cast(x as int) as x from dil")
def dilate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dilation by the 5-pixel ellipse."""
    return stencil.dilate(fx.foreground(spark, sf_dir, 0.2), fx.raster_meta(spark, sf_dir), stencil.ellipse(5)).select("y", "x")


@query(f"""with {_DIL}, need as (select d.y, d.x, count(*) as n, count(q.y) as hit from dil d cross join k cross join meta
  left join dil q on q.y=d.y+dy and q.x=d.x+dx where d.y+dy between 0 and h-1 and d.x+dx between 0 and w-1 group by d.y, d.x)
select cast(y as int) as y, cast(x as int) as x from need where n=hit""")  # fmt: skip
def close_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Morphological closing by the 5-pixel ellipse."""
    return stencil.close(fx.foreground(spark, sf_dir, 0.2), fx.raster_meta(spark, sf_dir), 5).select("y", "x")


@query(f"""with recursive {PIX}, key as (select y, x, y*64+x as id from pix),
psym as materialized (select p.id as a, q.id as b from key p cross join eight join key q on q.y=p.y+dy and q.x=p.x+dx),
{comp('select id, id from key', 'psym')}
select y, x from key join comp on id=k where v in (select v from comp group by v having count(*)>=3)""")  # fmt: skip
def small_component_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels of components of three pixels or more."""
    return raster.drop_small(fx.foreground(spark, sf_dir, SPARSE), 3).select("y", "x")


_TRACE = f"""{PIX}, nodes as materialized (select row_number() over (order by y, x)-1 as id, y, x from cnt where n=1 or n>=3),
chain as materialized (select y, x, y*64+x as id from cnt where n=2),
steps as (select dy, dx, row_number() over (order by dy, dx)-1 as step, sqrt(cast(abs(dy)+abs(dx) as double)) as len from eight),
csym as materialized (select p.id as a, q.id as b, len from chain p cross join steps join chain q on q.y=p.y+dy and q.x=p.x+dx),
{comp('select id, id from chain', 'csym')},
touch as materialized (select n.id as node, step, len, v from nodes n cross join steps join chain c on c.y=n.y+dy and c.x=n.x+dx join comp on k=c.id),
inner_len as (select v, sum(len)/2 as inside from csym join comp on k=a group by v), pixels as (select v, count(*) as pixels from comp group by v),
ends as (select v, count(*) as k, sum(len) as outside, min((node, step)) as first, max(node) as b from touch group by v),
raw as materialized (select first[1] as a, b, first[2] as step, outside+coalesce(inside, 0) as length, pixels+2 as n_pix
  from ends join pixels using (v) left join inner_len using (v) where k=2 and first[1]<b
  union all select n.id, m.id, step, len, 2 from nodes n cross join steps join nodes m on m.y=n.y+dy and m.x=n.x+dx where n.id<m.id),
kept as (select * from raw qualify row_number() over (partition by a, b, n_pix order by step, length)=1),
traced as (select a, b, arg_min({{'length': length, 'n_pix': n_pix}}, (length, step, n_pix)) as m from kept group by a, b)"""


@query(f"with recursive {_TRACE} select a, b, round(m.length, 6) as length, m.n_pix as n_pix from traced")
def trace_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between node pixels by chain contraction."""
    _, edges = skeleton.trace_edges(fx.foreground(spark, sf_dir, SPARSE))
    return edges.select("a", "b", r6("length"), "n_pix")


@query("""with p as (select user_id, event_id, cast(floor(epoch(ts)) as double) as px, value as py from events),
d as (select user_id, sqrt(power(px-lag(px) over w, 2)+power(py-lag(py) over w, 2)) as d from p window w as (partition by user_id order by px, event_id))
select user_id, count(*) as n_points, round(coalesce(sum(d), 0), 3) as length from d group by user_id""")
def polyline_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lengths of the users' point sequences."""
    rows = skeleton.polyline_lengths(fx.trajectories(spark, sf_dir), ["user_id"], ["px", "event_id"])
    return rows.select("user_id", "n_points", r6("length", 3))


@query("select least(l_partkey, l_suppkey) as a, greatest(l_partkey, l_suppkey) as b, min(l_extendedprice) as weight from lineitem group by 1, 2")
def edge_dedupe_shortest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shortest of parallel edges."""
    return graph.build_graph(fx.parallel_edges(spark, sf_dir)).select("a", "b", "weight")


@query(f"""with {CELL}, {META}, s as (select vec_id as y0, cast(embedding[3] as double)*60+32 as e from embeddings),
seg as (select 5 as x0, y0, cast(floor(e) as int) as x1, y0+4 as y1 from s),
g as (select distinct y, x from seg, (select unnest(range(-3, 8)) as oy), (select unnest(range(64)) as x), meta, lateral (select y0+oy as y) l1,
  lateral (select greatest(0.0e0, least(1.0e0, ((x-x0)*(x1-x0)+(y-y0)*(y1-y0))/cast((x1-x0)*(x1-x0)+(y1-y0)*(y1-y0) as double))) as t) l2
  where y between 0 and h-1 and power(x-x0-t*(x1-x0), 2)+power(y-y0-t*(y1-y0), 2)<=2.25e0)
select cast(y as int) as y, cast(x as int) as x from g""")  # fmt: skip
def vector_raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment of every row, drawn 3 pixels wide."""
    return _drawn(spark, sf_dir, fx.table(spark, sf_dir, "embeddings"))


def _drawn(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    x1 = F.floor(F.element_at("embedding", 3).cast("double") * 60 + 32).cast("int")
    seg = rows.select(F.lit(0).cast("long").alias("img_id"), F.lit(5).alias("x0"), F.col("vec_id").alias("y0"), x1.alias("x1"), (F.col("vec_id") + 4).alias("y1"))
    return raster.rasterise_segments(seg, fx.raster_meta(spark, sf_dir), 3.0).select("y", "x")


@query()
def skeletonize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Thinning of the closed dense raster."""
    meta = fx.raster_meta(spark, sf_dir)
    return skeleton.skeletonize(stencil.close(fx.foreground(spark, sf_dir, 0.05), meta, 3)).select("y", "x")


# ---- graph, components, healing -------------------------------------------------------------


def _graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return fx.geo_nodes(spark, sf_dir), materialize(fx.geo_edges(spark, sf_dir), "geo_edges")


@query(f"with {NODES}, {EDGES} select a, b, round(length, 6) as length, w from geo_edges")
def radius_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fixture graph by a grid distance join."""
    return fx.geo_edges(spark, sf_dir).select("a", "b", r6("length"), "w")


@query(f"with {GRAPH} select a as node_id, count(*) as degree, count(*)=1 as endpoint from sym group by a")
def degree_endpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees, and which nodes dangle."""
    return graph.degrees(fx.geo_edges(spark, sf_dir)).withColumn("endpoint", F.col("degree") == 1)


_CAND = f"""{GRAPH}, ends as (select a as id, min(b) as other from sym group by a having count(*)=1),
stub as materialized (select e.id, n.x, n.y, (n.x-o.x)/len as ux, (n.y-o.y)/len as uy from ends e join geo_nodes n on n.node_id=e.id
  join geo_nodes o on o.node_id=e.other, lateral (select sqrt(cast((n.x-o.x)*(n.x-o.x)+(n.y-o.y)*(n.y-o.y) as double)) as len) l),
near as (select s.id as a, t.id as b, d as dist, s.ux as aux, s.uy as auy, t.ux as bux, t.uy as buy, (t.x-s.x)/d as vx, (t.y-s.y)/d as vy
  from stub s join stub t on s.id<t.id, lateral (select sqrt(cast((s.x-t.x)*(s.x-t.x)+(s.y-t.y)*(s.y-t.y) as double)) as d) l where d>0 and d<=80),
angled as (select *, (degrees(acos(greatest(-1.0e0, least(1.0e0, aux*vx+auy*vy))))+degrees(acos(greatest(-1.0e0, least(1.0e0, -(bux*vx+buy*vy))))))/2 as angle from near),
cand as materialized (select a, b, dist, angle, dist*(1+1.5e0*angle/60) as cost from angled where angle<=60)"""


def _stubs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir)
    stubs = heal.stub_directions(heal.endpoints(nodes, edges), nodes, edges)
    return nodes, edges, materialize(heal.bridge_candidates(stubs, FIXTURE_HEAL), "candidates")


@query(f"with {_CAND} select a, b, round(dist, 6) as dist, round(angle, 6) as angle, round(cost, 6) as cost from cand")
def bridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """End pairs within the gap that point at each other."""
    _, _, found = _stubs(spark, sf_dir)
    return found.select("a", "b", r6("dist"), r6("angle"), r6("cost"))


# a candidate is in the forest if no path of cheaper candidates joins its components
_FOREST = f"""{comp()}, ranked as materialized (select *, row_number() over (order by cost, a, b) as r from cand),
tagged as materialized (select r.*, c.v as ca, d.v as cb from ranked r join comp c on c.k=a join comp d on d.k=b),
reach(r, c) as (select r, ca from tagged where ca<>cb union
  select p.r, case when t.ca=p.c then t.cb else t.ca end from reach p join tagged t on t.r<p.r and (t.ca=p.c or t.cb=p.c)),
forest as (select a, b, dist, cost from tagged t where ca<>cb and not exists (select 1 from reach p where p.r=t.r and p.c=t.cb))"""


@query(f"with recursive {_CAND}, {_FOREST} select a, b, round(dist, 6) as dist from forest")
def spanning_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first healing pass: the minimum spanning forest over the components."""
    nodes, edges, found = _stubs(spark, sf_dir)
    return heal.spanning_bridges(found, components(nodes, edges)).select("a", "b", r6("dist"))


# sequential greedy over the free candidates, carrying the list of used nodes
_MATCH = """free as (select *, row_number() over (order by cost, a, b) as n from cand c
  where not exists (select 1 from forest f where c.a in (f.a, f.b) or c.b in (f.a, f.b))),
greedy(n, used, took) as (select cast(0 as bigint), cast([] as bigint[]), false union all
  select f.n, case when list_contains(g.used, f.a) or list_contains(g.used, f.b) then g.used else list_concat(g.used, [f.a, f.b]) end,
    not (list_contains(g.used, f.a) or list_contains(g.used, f.b)) from greedy g join free f on f.n=g.n+1)"""


@query(f"with recursive {_CAND}, {_FOREST}, {_MATCH} select a, b, round(dist, 6) as dist from free join greedy using (n) where took")
def stub_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second healing pass: a matching of the ends that are still free."""
    nodes, edges, found = _stubs(spark, sf_dir)
    forest = materialize(heal.spanning_bridges(found, components(nodes, edges)), "forest")
    used = forest.select(F.col("a").alias("node_id")).unionByName(forest.select(F.col("b").alias("node_id")))
    return heal.stub_matching(found, used).select("a", "b", r6("dist"))


@query(f"""with recursive {_CAND}, {_FOREST}, {_MATCH} select cast((select count(*) from stub) as bigint) as endpoints, (select count(*) from cand) as candidate_bridges,
  (select count(*) from forest)+(select count(*) from greedy where took) as bridges_added, (select count(*) from forest) as bridges_mst,
  (select count(*) from greedy where took) as bridges_stub_repair, 80.0e0 as max_gap_px, 60.0e0 as max_angle_deg""")  # fmt: skip
def healing_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diagnostics of both healing passes."""
    return heal.heal(*_graph(spark, sf_dir), FIXTURE_HEAL)[2]


@query(f"with recursive {GRAPH}, {comp()} select k as node_id, v as component from comp")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of the fixture graph."""
    return components(*_graph(spark, sf_dir))


@query(f"with recursive {GRAPH}, {LCC} select node_id from core")
def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the largest component."""
    return graph.largest_component(*_graph(spark, sf_dir)).select("node_id")


@query(f"""with recursive {_CAND}, {_FOREST}, {_MATCH}, more as (select a, b from forest union all select a, b from free join greedy using (n) where took),
hsym as materialized (select a, b from sym union all select a, b from more union all select b, a from more),
{comp('select node_id, node_id from geo_nodes', 'hsym', 'comp2')},
b4 as (select max(n) m, count(*) k from (select count(*) n from comp group by v)), af as (select max(n) m, count(*) k from (select count(*) n from comp2 group by v)),
tot as (select count(*) n from geo_nodes), ed as (select count(*) n from (select distinct a, b from hsym where a<b))
select tot.n as nodes, ed.n as edges, b4.m as lcc_before_heal, af.m as lcc_after_heal, round(b4.m/tot.n, 4) as lcc_before_frac, round(af.m/tot.n, 4) as lcc_after_frac,
  round((af.m-b4.m)/tot.n, 4) as connectivity_gain_frac, b4.k as num_components_before, af.k as num_components_after from tot, ed, b4, af""")  # fmt: skip
def connectivity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connectivity before and after healing."""
    nodes, edges = _graph(spark, sf_dir)
    healed, _, _ = heal.heal(nodes, edges, FIXTURE_HEAL)
    return graph.connectivity_report(nodes, graph.build_graph(edges), materialize(graph.build_graph(healed), "healed"))


# ---- paths and centrality -------------------------------------------------------------------


def dist(sources: str, sym: str = "sym", name: str = "dist") -> str:
    return f"""{name}(s, t, d) using key (s, t) as (select s, s, cast(0 as bigint) from ({sources}) union
  select p.s, e.b, min(p.d+e.w) from {name} p join {sym} e on e.a=p.t left join recurring.{name} old on old.s=p.s and old.t=e.b
  where old.d is null or p.d+e.w<old.d group by p.s, e.b)"""


@query(f"with recursive {GRAPH}, {dist('select node_id as s from geo_nodes')} select s as src, t as dst, d as dist from dist")
def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from every node."""
    nodes, edges = _graph(spark, sf_dir)
    return paths.distances(edges, nodes.select(F.col("node_id").alias("src")), "w")


@query(ORACLES["shortest_paths"])
def shortest_paths_relaxed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same distances by frontier relaxation in tasks that get the graph in blocks, the form for graphs too large to broadcast."""
    nodes, edges = _graph(spark, sf_dir)
    return paths.distances(edges, nodes.select(F.col("node_id").alias("src")), "w", limit=0)


_COUNTS = f"""{LCC}, {dist('select node_id as s from core', 'core_sym')},
dag as materialized (select p.s, p.t as u, e.b as v from dist p join core_sym e on e.a=p.t join dist q on q.s=p.s and q.t=e.b where p.d+e.w=q.d),
hops(s, t, h, c) as (select node_id, node_id, 0, cast(1 as double) from core union all
  select g.s, g.v, h.h+1, sum(h.c) from hops h join dag g on g.s=h.s and g.u=h.t group by g.s, g.v, h.h+1),
sigma as materialized (select s, t, sum(c) as c from hops group by s, t), m as (select count(*) as n from core),
full_ as materialized (select d.s, d.t, d.d, c from dist d join sigma g on g.s=d.s and g.t=d.t)"""
_NODE_BC = """node_bc as materialized (select v.t as node_id, sum(v.c*w.c/st.c)/((max(n)-1)*(max(n)-2)) as bc from full_ v join full_ w on w.s=v.t join full_ st on st.s=v.s and st.t=w.t, m
  where v.d+w.d=st.d and v.s<>v.t and w.t<>v.t group by v.t)"""


def _core(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = _graph(spark, sf_dir)
    core = materialize(graph.largest_component(nodes, edges), "core")
    return core, materialize(graph.induced(core, edges, whole=True), "core_edges")


@query(f"with recursive {GRAPH}, {_COUNTS}, {_NODE_BC} select node_id, round(coalesce(bc, 0), 6) as bc from core left join node_bc using (node_id)")
def node_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of the nodes of the largest component."""
    return paths.betweenness(*_core(spark, sf_dir), "w")[0].select("node_id", r6("bc"))


@query(f"""with recursive {GRAPH}, {_COUNTS} select g.u as a, g.v as b, round(coalesce(sum(x.c*y.c/st.c), 0)/(max(n)*(max(n)-1)), 6) as bc
  from (select a as u, b as v, w from core_sym) g join full_ x on x.t=g.u join full_ y on y.s=g.v join full_ st on st.s=x.s and st.t=y.t and x.d+g.w+y.d=st.d, m
  group by g.u, g.v having g.u<g.v and false union all
  select a, b, round(sum(c)/(max(n)*(max(n)-1)), 6) from (select least(g.a, g.b) as a, greatest(g.a, g.b) as b, coalesce(x.c*y.c/st.c, 0) as c from core_sym g
    join full_ x on x.t=g.a join full_ y on y.s=g.b join full_ st on st.s=x.s and st.t=y.t and x.d+g.w+y.d=st.d
    union all select a, b, 0 from core_sym where a<b), m group by a, b""")  # fmt: skip
def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness of the edges of the largest component."""
    return paths.betweenness(*_core(spark, sf_dir), "w")[1].select("a", "b", r6("bc"))


@query(f"""with recursive {GRAPH}, {_COUNTS}, {_NODE_BC}, top as (select node_id, bc from node_bc order by bc desc, node_id limit 8)
select cast(row_number() over (order by bc desc, node_id) as int) as rank, node_id, round(bc, 5) as bc, x, y from top join geo_nodes using (node_id)""")  # fmt: skip
def gatekeepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The eight nodes of highest betweenness."""
    core, edges = _core(spark, sf_dir)
    return paths.gatekeepers(core, materialize(paths.betweenness(core, edges, "w")[0], "bc"), 8)


@query()
def sampled_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Betweenness estimated from 32 sources."""
    return paths.betweenness(*_core(spark, sf_dir), "w", k=32)[0].select("node_id", r6("bc"))


# ---- stress tests ---------------------------------------------------------------------------

#: The operator's own number of pairs.
PAIRS = 250


def _removals(core: DataFrame, edges: DataFrame, n: int = 8) -> DataFrame:
    """A cheap ranking for the fixture: by degree, then id."""
    ranked = graph.degrees(edges).join(core.select("node_id"), "node_id").orderBy(F.desc("degree"), "node_id").limit(n)
    return paths.gatekeepers(core, ranked.select("node_id", F.col("degree").cast("double").alias("bc")), n)


_STRESS = f"""{LCC}, dense as (select node_id, row_number() over (order by node_id)-1 as i from core), total as (select count(*) n from core),
draws as (select id, ('0x'||substr(md5('11:a:'||id),1,12))::bigint%n as i, ('0x'||substr(md5('11:b:'||id),1,12))::bigint%(n-1) as k from (select unnest(range({{draws}})) as id), total),
pairs as materialized (select id as pair_id, a.node_id as src, b.node_id as dst from draws d join dense a on a.i=d.i join dense b on b.i=case when k>=d.i then k+1 else k end order by id limit {PAIRS}),
ranked as (select a as node_id, count(*) as deg from core_sym group by a), top as materialized (select node_id, row_number() over (order by deg desc, node_id) as r from ranked qualify r<=8)"""


_STEP_SQL = """steps as (select unnest(range(0, 9)) as step), gone as materialized (select step, node_id from steps join top on r<=step),
ssym as materialized (select step*1000000+a as a, step*1000000+b as b, w from core_sym, steps where not exists (select 1 from gone g where g.step=steps.step and g.node_id in (a, b))),
asked as (select distinct step*1000000+src as s from pairs, steps where not exists (select 1 from gone g where g.step=steps.step and g.node_id in (src, dst)))"""


_TOLD = """found as (select steps.step, pair_id, d from steps cross join pairs left join {dist} on s=steps.step*1000000+src and t=steps.step*1000000+dst
  and not exists (select 1 from gone g where g.step=steps.step and g.node_id in (src, dst))),
agg as (select step, count(*) as n, count(d) as ok, coalesce(sum(d), 0) as total, sum(case when d>0 then 1.0e0/d else 0 end) as inv from found group by step),
base as (select total/ok as len, inv/n as eff from agg where step=0), lcc as (select v//1000000 as step, max(c) as m from (select v, count(*) as c from scomp group by v) group by 1),
fin as (select agg.*, base.*, case when step=0 then base.len else (total+(n-ok)*3.0e0*base.len)/n end as cur from agg, base)
select cast(fin.step as int) as step, node_id as removed_node, cast(fin.step as int) as removed_count, round(cur, 3) as avg_path_len,
  round(case when fin.step=0 then 1 else len/cur end, 4) as resilience_index, round(inv/n, 6) as efficiency, round(case when fin.step=0 then 1 else inv/n/eff end, 4) as efficiency_retained,
  round(coalesce(m, 0)/(select n from total), 4) as lcc_frac, ok as reachable_pairs from fin left join lcc on lcc.step=fin.step left join top on r=fin.step"""


@query(f"""with recursive {GRAPH}, {_STRESS.replace("{draws}", str(2 * PAIRS))}, {_STEP_SQL}, {dist("select s from asked", "ssym")},
{comp("select step*1000000+node_id, step*1000000+node_id from core, steps where not exists (select 1 from gone g where g.step=steps.step and g.node_id=core.node_id)", "ssym", "scomp")},
{_TOLD.replace('{dist}', 'dist')}""")  # fmt: skip
def stress_by_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative removal of the eight nodes of highest degree."""
    core, edges = _core(spark, sf_dir)
    top = materialize(_removals(core, edges), "top")
    return ablation.stress_test(core, edges, top, pairs=PAIRS, weight="w", connected=True)


_HEALED = f"""{_CAND}, {_FOREST}, {_MATCH}, more as (select a, b, dist from forest union all select a, b, dist from free join greedy using (n) where took),
hs as materialized (select a, b, min(w) as w from (select a, b, w from sym union all select a, b, cast(round(1000*dist) as bigint) from more
  union all select b, a, cast(round(1000*dist) as bigint) from more) group by a, b)"""
_HEALED_LCC = f"""{comp(sym="hs", name="hcomp")}, sizes as (select v, count(*) n from hcomp group by v),
core as materialized (select k as node_id from hcomp where v=(select v from sizes order by n desc, v limit 1)),
core_sym as materialized (select s.* from hs s join core c on s.a=c.node_id)"""
_DRAWN = _STRESS.split("\nranked as")[0].removeprefix(f"{LCC}, ").rstrip(",").replace("{draws}", str(2 * PAIRS))


@query(f"""with recursive {_HEALED}, {_COUNTS.replace(LCC, _HEALED_LCC)}, {_NODE_BC},
top as materialized (select node_id, row_number() over (order by bc desc, node_id) as r from node_bc qualify r<=8), {_DRAWN}, {_STEP_SQL}, {dist("select s from asked", "ssym", "sdist")},
{comp("select step*1000000+node_id, step*1000000+node_id from core, steps where not exists (select 1 from gone g where g.step=steps.step and g.node_id=core.node_id)", "ssym", "scomp")},
{_TOLD.replace('{dist}', 'sdist')}""")  # fmt: skip
def stress_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative removal of the eight nodes of highest betweenness from the healed graph's largest component."""
    nodes, edges = _graph(spark, sf_dir)
    healed, _, _ = heal.heal(nodes, edges, FIXTURE_HEAL)
    whole = graph.build_graph(healed).withColumn("w", F.round(1000 * F.col("weight")).cast("long"))
    whole = materialize(whole, "healed")
    core = materialize(graph.largest_component(nodes, whole), "core")
    core_edges = materialize(graph.induced(core, whole), "core_edges")
    top = materialize(paths.gatekeepers(core, materialize(paths.betweenness(core, core_edges, "w")[0], "bc"), 8), "top")
    return ablation.stress_test(core, core_edges, top, weight="w")


@query(f"""with recursive {GRAPH}, {_STRESS.replace("{draws}", str(PAIRS))}, {_STEP_SQL.replace("range(0, 9)", "[0, 3]")}, {dist("select s from asked", "ssym")},
{comp("select step*1000000+node_id, step*1000000+node_id from core, steps where not exists (select 1 from gone g where g.step=steps.step and g.node_id=core.node_id)", "ssym", "scomp")},
found as (select steps.step, pair_id, d from steps cross join pairs left join dist on s=steps.step*1000000+src and t=steps.step*1000000+dst
  and not exists (select 1 from gone g where g.step=steps.step and g.node_id in (src, dst))),
agg as (select step, count(*) as n, count(d) as ok, coalesce(sum(d), 0) as total from found group by step), base as (select total/ok as len from agg where step=0),
fin as (select ok, round(len/((total+(n-ok)*3.0e0*len)/n), 3) as r from agg, base where step=3),
lcc as (select max(c) as m from (select v, count(*) as c from scomp where v>=3000000 group by v))
select r as resilience_index, round(m/(select n from total), 4) as lcc_frac, ok as reachable_pairs, case when r<0.6 then 'severe' when r<0.85 then 'warning' else 'ok' end as severity from fin, lcc""")  # fmt: skip
def what_if(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What closing the three nodes of highest degree would do."""
    core, edges = _core(spark, sf_dir)
    closed = materialize(_removals(core, edges).where("rank <= 3").select("node_id"), "closed")
    return ablation.what_if(core, edges, closed, pairs=PAIRS, weight="w", connected=True)


# ---- scores ---------------------------------------------------------------------------------

_WIDE = f"{CELL}, {META}, {GT}, {PRED}, {_NINE}, {OCC}, region as (select y, x from gt except select y, x from occ)"
_COUNT = """c as (select (select count(*) from gt join pred using (y, x)) as tp, (select count(*) from pred) as p, (select count(*) from gt) as g)"""
_DILS = """dg as materialized (select distinct y+dy as y, x+dx as x from gt, nine), dp as materialized (select distinct y+dy as y, x+dx as x from pred, nine),
r as (select (select count(*) from pred join dg using (y, x)) as rtp, (select count(*) from gt join dp using (y, x)) as cov)"""
_OREC = "(select (count(p.y)+1e-6)/(count(*)+1e-6) from region r join gt using (y, x) left join pred p using (y, x))"


@query(f"""with {_WIDE}, {_COUNT}, {_DILS} select round((tp+1e-6)/(p+g-tp+1e-6), 4) as iou, round((2*tp+1e-6)/(p+g+1e-6), 4) as dice, round((tp+1e-6)/(p+1e-6), 4) as precision,
  round((tp+1e-6)/(g+1e-6), 4) as recall, round((rtp+1e-6)/(rtp+(p-rtp)+(g-cov)+1e-6), 4) as relaxed_iou, round({_OREC}, 4) as occlusion_recall from c, r""")  # fmt: skip
def seg_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All overlap scores of the shifted prediction."""
    truth = fx.foreground(spark, sf_dir, 0.10)
    region = raster.occluded_region(truth, raster.occlude(truth, fx.shapes(spark)))
    return metrics.segmentation_report(fx.prediction(spark, sf_dir), truth, fx.raster_meta(spark, sf_dir), region).drop("img_id")


@query(f"with {_WIDE}, {_COUNT}, {_DILS} select rtp, p-rtp as rfp, g-cov as rfn, round((rtp+1e-6)/(rtp+(p-rtp)+(g-cov)+1e-6), 6) as relaxed_iou from c, r")
def relaxed_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap within four pixels."""
    c = metrics.overlap_counts(fx.prediction(spark, sf_dir), fx.foreground(spark, sf_dir, 0.10), fx.raster_meta(spark, sf_dir))
    return c.select("rtp", "rfp", "rfn", F.round(metrics.relaxed_iou(c), 6).alias("relaxed_iou"))


@query(f"with {_WIDE} select (select count(*) from region) as region_truth, round({_OREC}, 6) as occlusion_recall")
def occlusion_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall under the occluding shapes."""
    truth = fx.foreground(spark, sf_dir, 0.10)
    region = raster.occluded_region(truth, raster.occlude(truth, fx.shapes(spark)))
    c = metrics.overlap_counts(fx.prediction(spark, sf_dir), truth, None, 4, region)
    return c.select("region_truth", F.round(metrics.occlusion_recall(c), 6).alias("occlusion_recall"))


@query(f"""with recursive {GRAPH}, ref_nodes as materialized (select node_id, x+2 as x, y-1 as y from geo_nodes where node_id%3<>0),
ref_sym as materialized (select s.* from sym s where a%3<>0 and b%3<>0),
near as materialized (select n.node_id, arg_min(m.node_id, (cast((n.x-m.x)*(n.x-m.x)+(n.y-m.y)*(n.y-m.y) as double), m.node_id)) as ref_id from geo_nodes n, ref_nodes m group by n.node_id),
dense as (select node_id, row_number() over (order by node_id)-1 as i from geo_nodes), total as (select count(*) n from geo_nodes),
draws as (select id, ('0x'||substr(md5('11:a:'||id),1,12))::bigint%n as i, ('0x'||substr(md5('11:b:'||id),1,12))::bigint%(n-1) as k from (select unnest(range(1600)) as id), total),
pairs as materialized (select id, a.node_id as src, b.node_id as dst from draws d join dense a on a.i=d.i join dense b on b.i=case when k>=d.i then k+1 else k end),
{dist("select distinct src as s from pairs")}, mapped as materialized (select id, d as own, x.ref_id as ra, y.ref_id as rb from pairs join dist on s=src and t=dst
  join near x on x.node_id=src join near y on y.node_id=dst where x.ref_id<>y.ref_id),
{dist("select distinct ra as s from mapped", "ref_sym", "rdist")},
err as (select abs(own-d)/cast(d as double) as e from mapped join rdist on s=ra and t=rb where d>0 order by id limit 200)
select count(*) as pairs_compared, round(avg(e), 4) as mean_rel_path_error, round(median(e), 4) as median_rel_path_error from err having count(*)>0""")  # fmt: skip
def topo_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Path lengths of the graph against those of a thinned, displaced reference."""
    nodes, edges = _graph(spark, sf_dir)
    ref = nodes.where("node_id % 3 <> 0").select("node_id", (F.col("x") + 2).alias("x"), (F.col("y") - 1).alias("y"))
    ref_edges = edges.where("a % 3 <> 0 and b % 3 <> 0")
    return metrics.topological_accuracy(nodes, edges, ref, ref_edges, weight="w")


def _logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.cells(spark, sf_dir).select("img_id", "y", "x", (8 * F.col("v")).alias("z"), (F.col("v") > 0.1).cast("int").alias("t"))


_SOBEL = "sob(dy, dx, kx, ky) as (values (-1,-1,-1,-1), (-1,0,0,-2), (-1,1,1,-1), (0,-1,-2,0), (0,1,2,0), (1,-1,-1,1), (1,0,0,2), (1,1,1,1))"


def _grad(col: str) -> str:
    return f"(select c.y, c.x, sqrt(power(coalesce(sum(kx*q.{col}), 0), 2)+power(coalesce(sum(ky*q.{col}), 0), 2)+1e-6) as g from lg c cross join sob left join lg q on q.y=c.y+dy and q.x=c.x+dx group by c.y, c.x)"


_LG = f"{CELL}, lg as materialized (select y, x, 8*v as z, cast(v>0.1 as double) as t, 1/(1+exp(-8*v)) as p from cell), {_SOBEL}, gp as {_grad('p')}, gt2 as {_grad('t')}"


@query(f"""with {_LG}, s as (select sum(p*t) as pt, sum(p) as sp, sum(t) as st, avg(greatest(z, 0)-z*t+ln(1+exp(-abs(z)))) as bce from lg),
b as (select avg(abs(gp.g-gt2.g)) as boundary from gp join gt2 using (y, x)), l as (select bce, 1-(2*pt+1)/(sp+st+1) as d, 1-(pt+1)/(sp+st-pt+1) as i, boundary from s, b)
select round(bce, 6) as bce, round(d, 6) as dice_loss, round(i, 6) as iou_loss, round(boundary, 6) as boundary_loss, round(bce+d+0.5*i+0.5*boundary, 6) as combined from l""")  # fmt: skip
def soft_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training losses of probabilities against the truth."""
    rows = metrics.soft_losses(_logits(spark, sf_dir), fx.raster_meta(spark, sf_dir))
    return rows.select(*[r6(c) for c in ("bce", "dice_loss", "iou_loss", "boundary_loss", "combined")])


@query(f"with {_LG} select y, x, round(g, 6) as v from gp")
def sobel_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gradient magnitudes of the probabilities."""
    rows = _logits(spark, sf_dir).withColumn("p", metrics.sigmoid(F.col("z")))
    return stencil.gradient(rows, fx.raster_meta(spark, sf_dir), "p").select("y", "x", r6("v"))


# ---- tiles, exports, streaming --------------------------------------------------------------


@query(f"""with {CELL}, {META}, ty as (select unnest(range(0, greatest(1, h-1), 24)) as ty from meta), tx as (select unnest(range(0, greatest(1, w-1), 24)) as tx from meta),
s as (select y, x, 1/(1+exp(-(8*v+(ty//24+tx//24)%3*0.1e0))) as p from cell join ty on y between ty and ty+31 join tx on x between tx and tx+31)
select y, x, round(avg(p), 6) as p, avg(p)>0.5 as road from s group by y, x""")  # fmt: skip
def tile_mosaic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probability over overlapping tiles of 32 with a step of 24."""
    rows = tiles.in_tiles(fx.cells(spark, sf_dir), fx.raster_meta(spark, sf_dir), 32, 24)
    bias = F.expr("(ty div 24 + tx div 24) % 3") * 0.1
    scored = rows.select("img_id", "y", "x", metrics.sigmoid(8 * F.col("v") + bias).alias("p"))
    return tiles.mosaic(scored).select("y", "x", r6("p"), "road")


@query(f"""with {CELL}, {META}, {GT}, ty as (select unnest(range(0, greatest(1, h-32+1), 24)) as ty from meta), tx as (select unnest(range(0, greatest(1, w-32+1), 24)) as tx from meta),
s as (select ty, tx, count(*)/1024.0e0 as share from gt join ty on y between ty and ty+31 join tx on x between tx and tx+31 group by ty, tx)
select cast(ty as int) as ty, cast(tx as int) as tx, round(share, 6) as share from s where share>=0.01 order by ty, tx limit 400""")  # fmt: skip
def training_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Full tiles with enough truth."""
    rows = tiles.training_tiles(fx.foreground(spark, sf_dir, 0.10), fx.raster_meta(spark, sf_dir), 32, 24)
    return rows.select("ty", "tx", r6("share"))


@query(f"""with recursive {GRAPH}, {_COUNTS}, {_NODE_BC}, top as (select node_id from node_bc order by bc desc, node_id limit 8),
ebc as (select a, b, sum(c)/(max(n)*(max(n)-1)) as bc from (select least(g.a, g.b) as a, greatest(g.a, g.b) as b, x.c*y.c/st.c as c from core_sym g
    join full_ x on x.t=g.a join full_ y on y.s=g.b join full_ st on st.s=x.s and st.t=y.t and x.d+g.w+y.d=st.d), m group by a, b),
roads as (select e.a, e.b, length, coalesce(bc, 0) as bc from geo_edges e join core on core.node_id=e.a left join ebc using (a, b))
select 'road' as kind, a as u, b as v, round(bc, 6) as criticality, round(bc/(select max(bc) from roads), 6) as relative, false as healed, round(length, 2) as length_px,
  cast(null as double) as betweenness, cast(null as boolean) as gatekeeper, cast(p.x as double) as x, cast(p.y as double) as y from roads join geo_nodes p on p.node_id=a
union all select 'intersection', node_id, null, null, null, null, null, round(coalesce(bc, 0), 6), node_id in (select node_id from top), cast(x as double), cast(y as double)
  from core join geo_nodes using (node_id) left join node_bc using (node_id)""")  # fmt: skip
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of the largest component, unpacked, with the first coordinate."""
    core, edges = _core(spark, sf_dir)
    node_bc, edge_bc = paths.betweenness(core, edges, "w")
    node_bc = materialize(node_bc, "bc")
    weighted = edges.select("a", "b", F.col("length").alias("weight"), F.lit(False).alias("healed"))
    rows = export.features(core, weighted, materialize(edge_bc, "ebc"), node_bc, paths.gatekeepers(core, node_bc, 8))
    at = F.col("coordinates")[0]
    return rows.withColumn("x", at[0]).withColumn("y", at[1]).drop("coordinates")


@query(f"with {NODES}, {EDGES} select count(*)+(select count(*) from geo_nodes) as n, (select count(*) from geo_nodes) as points, count(*) as lines from geo_edges")
def geojson_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature texts parsed back and counted by geometry."""
    nodes, edges = _graph(spark, sf_dir)
    weighted = edges.select("a", "b", F.col("length").alias("weight"), F.lit(False).alias("healed"))
    none = edges.select("a", "b", F.lit(0.0).alias("bc"))
    bc = nodes.select("node_id", F.lit(0.0).alias("bc"))
    texts = export.feature_json(export.features(nodes, weighted, none, bc, bc.limit(0)))
    kind = F.get_json_object("value", "$.geometry.type")
    return texts.agg(F.count(F.lit(1)).alias("n"), F.count_if(kind == "Point").alias("points"), F.count_if(kind == "LineString").alias("lines"))


@query("""select time_bucket(interval 1 hour, cast(ts as timestamp)) as start, event_type as kind, count(*) as n, round(sum(value), 4) as total from events group by 1, 2""")
def closure_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed event counts, the batch form of the streaming extension."""
    from wayfabric.streaming.closures import closure_rates as rates

    return rates(fx.table(spark, sf_dir, "events")).select(F.col("start").cast("timestamp_ntz").alias("start"), "kind", "n", r6("total", 4))


@query()
def resilience_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report document of the fixture graph as one JSON text."""
    from wayfabric.config import Settings
    from wayfabric.plans.resilience import analyse_graph

    out = analyse_graph(*_graph(spark, sf_dir), Settings(heal=FIXTURE_HEAL))
    return export.report({k: out[k] for k in ("healing", "connectivity", "gatekeepers", "steps")}, {"input": "fixture"})


@query()
def synthetic_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole plan on the synthetic source with all defaults: one row of connectivity, healing, scores and the last step."""
    from wayfabric.config import Settings
    from wayfabric.plans.resilience import run

    out = run(spark, Settings(mode="synth"))
    last = out["steps"].orderBy(F.desc("step")).limit(1).drop("removed_node")
    return out["connectivity"].join(out["healing"]).join(out["segmentation"].drop("img_id")).join(last)  # single rows


@query()
def synthetic_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The synthetic road grid, rasterised at its default size."""
    from wayfabric.sources.synthetic import road_grid

    meta = spark.createDataFrame([(0, 636, 1245)], "img_id long, h int, w int")
    segments = spark.createDataFrame([(0, *s) for s in road_grid(636, 1245)], "img_id long, x0 int, y0 int, x1 int, y1 int")
    return raster.rasterise_segments(segments, meta, 14.0).select("y", "x")


# ---- further operators ----------------------------------------------------------------------


@query(f"""with {CELL}, {META}, g as (select y, x, greatest(0.0e0, least((y+0.5e0)*h/100-0.5e0, h-1)) as sy, greatest(0.0e0, least((x+0.5e0)*w/40-0.5e0, w-1)) as sx
  from (select unnest(range(100)) as y), (select unnest(range(40)) as x), meta), p as (select *, floor(sy) as fy, floor(sx) as fx from g),
k as (select y, x, fy as ay, fx as ax, (1-(sy-fy))*(1-(sx-fx)) as k from p union all select y, x, fy, least(fx+1, 63), (1-(sy-fy))*(sx-fx) from p
  union all select y, x, least(fy+1, h-1), fx, (sy-fy)*(1-(sx-fx)) from p, meta union all select y, x, least(fy+1, h-1), least(fx+1, 63), (sy-fy)*(sx-fx) from p, meta)
select cast(k.y as int) as y, cast(k.x as int) as x, round(sum(k*v), 6) as v from k join cell c on c.y=ay and c.x=ax group by k.y, k.x""")  # fmt: skip
def band_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A band resampled bilinearly to 100 by 40."""
    return px.resample(fx.cells(spark, sf_dir), fx.raster_meta(spark, sf_dir), 100, 40).select("y", "x", r6("v"))


_BUSY = "busy as materialized (select a as node_id from sym group by a having count(*)>=5)"


@query(f"with {GRAPH}, {_BUSY} select a, b, w from geo_edges where a not in (select node_id from busy) and b not in (select node_id from busy)")
def node_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges left when every node of degree 5 or more is gone."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.without_nodes(edges, graph.degrees(edges).where("degree >= 5").select("node_id")).select("a", "b", "w")


@query(f"with {GRAPH}, {_BUSY} select a, b, w from geo_edges where a in (select node_id from busy) and b in (select node_id from busy)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges between the nodes of degree 5 or more."""
    nodes, edges = _graph(spark, sf_dir)
    return graph.induced(graph.degrees(edges).where("degree >= 5").select("node_id"), edges).select("a", "b", "w")


@query(f"with recursive {GRAPH}, {_STRESS.replace('{draws}', str(2 * PAIRS))} select pair_id, src, dst from pairs")
def connected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled pairs that are connected."""
    return ablation.connected_pairs(*_core(spark, sf_dir), PAIRS, 2 * PAIRS)


@query(f"""with recursive {GRAPH}, {LCC}, {dist("select node_id as s from core")} select round(avg(d), 4) as avg_path_len, count(*) as pairs from dist where s<t""")
def mean_path_on_largest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean distance between all nodes of the largest component."""
    return ablation.mean_path_of_all(*_graph(spark, sf_dir), "w").select(r6("avg_path_len", 4), "pairs")


@query(f"""with recursive {_CAND}, {_FOREST}, {_MATCH}, more as (select a, b, 'mst' as pass from forest union all select a, b, 'stub' from free join greedy using (n) where took)
select a, b, pass, p.x as x0, p.y as y0, q.x as x1, q.y as y1 from more join geo_nodes p on p.node_id=a join geo_nodes q on q.node_id=b""")  # fmt: skip
def healing_overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plot-ready bridges of both passes."""
    nodes, edges = _graph(spark, sf_dir)
    return export.healing_overlay(nodes, heal.heal(nodes, edges, FIXTURE_HEAL)[1])


@query()
def recovered_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bridges of the fixture graph drawn into an empty mask."""
    nodes, edges = _graph(spark, sf_dir)
    bridges = heal.heal(nodes, edges, FIXTURE_HEAL)[1]
    meta = spark.createDataFrame([(0, 2000, 2000)], "img_id long, h int, w int")
    none = spark.createDataFrame([], "img_id long, y int, x int")
    return raster.recovered(none, meta, nodes, bridges).select("y", "x")
