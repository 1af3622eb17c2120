"""The same queries in DuckDB SQL, for N = 2, K = 4, C = 3."""

import math

from herdframe.operators.geometry import FAR
from herdframe.operators.posemodel import TRIES
from herdframe.operators.poses import log_norm
from herdframe.operators.tree import LEHMER, PRIME
from herdframe.plans import views
from herdframe.plans.mixture import FLAT_MIXTURE, MIXTURE, POSE_RADII, POSE_SEGMENT

E = """e as (
  select 'rec' || (event_id // 24 // 100)::varchar as recording, (event_id // 8) % 3 as camera, event_id // 24 as frame, (event_id // 2) % 4 as keypoint,
    event_id % 2 as instance, event_id, user_id, event_type = 'error' as missing, value, json_extract_string(props, '$.k')::double as k from events),
det as (select recording, camera, frame, keypoint, instance, case when not missing then value end as x, case when not missing then k end as y,
  case when missing then 0.0 else ((user_id * 37) % 101)::double / 101 end as confidence from e),
op as (select *, greatest(1e-5, least(1 - 1e-5, 1 - confidence))::double as outlier_prob from det)"""
ID = """ids as (select recording, camera, frame, keypoint, instance, a.animal, ln((((event_id * 31 + a.animal * 53) % 97)::double / 97) + 0.1) as score
  from e, (select unnest([0, 1])::bigint as animal) a),
il as (select recording, camera, frame, keypoint, instance, animal, score - ln(sum(exp(score)) over (partition by recording, camera, frame, keypoint, instance)) as logp from ids)"""
AF = """afs as (select recording, camera, frame, keypoint, instance, j as parent_instance,
    -ln(1 + exp(-((((event_id * 13 + (frame * 24 + camera * 8 + (keypoint - 1) * 2 + j) * 7) % 89)::double / 89) - 0.2) * 20)) as score
  from e, (select unnest([0, 1])::bigint as j) where keypoint > 0),
al as (select recording, camera, frame, keypoint, instance, parent_instance, score - ln(sum(exp(score)) over (partition by recording, camera, frame, keypoint, instance)) as logp from afs)"""
JS = """pr as (select recording, frame, keypoint, camera, instance, max(case when animal = 0 then exp(logp) end) as a0, max(case when animal = 1 then exp(logp) end) as a1 from il group by all),
pn as (select recording, frame, keypoint, camera, instance, (a0 + 1e-6) / (a0 + a1 + 2e-6) as p, (a1 + 1e-6) / (a0 + a1 + 2e-6) as q from pr)"""
_JSD = "(u.p * ln(2 * u.p / (u.p + v.p)) + u.q * ln(2 * u.q / (u.q + v.q)) + v.p * ln(2 * v.p / (u.p + v.p)) + v.q * ln(2 * v.q / (u.q + v.q))) / 2"
PAIRS = f"""pt as (select op.*, p, q from op join pn using (recording, frame, keypoint, camera, instance) where x is not null and y is not null and outlier_prob < 0.9),
pairs as (select u.recording, u.frame, u.keypoint, u.camera as cam1, u.instance as inst1, v.camera as cam2, v.instance as inst2, abs(u.y - v.y) / 2 as error, {_JSD} as divergence
  from pt u join pt v on u.recording = v.recording and u.frame = v.frame and u.keypoint = v.keypoint and u.camera > v.camera),
edges as (select * from pairs where error < 15 and divergence < 0.1)"""
REACH = """sym as (select recording, frame, keypoint, cam1 * 2 + inst1 as a, cam2 * 2 + inst2 as b from edges union select recording, frame, keypoint, cam2 * 2 + inst2, cam1 * 2 + inst1 from edges),
reach as (select recording, frame, keypoint, a, b from sym union select r.recording, r.frame, r.keypoint, r.a, s.b from reach r join sym s on s.recording = r.recording and s.frame = r.frame and s.keypoint = r.keypoint and s.a = r.b),
comp as (select recording, frame, keypoint, a as node, least(a, min(b)) as low from reach group by recording, frame, keypoint, a)"""
GROUPS = f"""{REACH},
scored as (select c.*, node // 2 as camera, node % 2 as instance, o.outlier_prob from comp c join op o on o.recording = c.recording and o.frame = c.frame and o.keypoint = c.keypoint and o.camera = node // 2 and o.instance = node % 2),
each as (select recording, frame, keypoint, low, round(sum(1 - outlier_prob), 9) as total, count(*) = count(distinct camera) as fine from scored group by all),
best as (select *, count(*) over (partition by recording, frame, keypoint) as many, row_number() over (partition by recording, frame, keypoint order by low) as place,
  row_number() over (partition by recording, frame, keypoint order by total desc, low) as rank from each),
kept as (select recording, frame, keypoint, low, fine, case when many <= {views.N} then place - 1 else {views.N} - rank end as group_id from best where many <= {views.N} or rank <= {views.N}),
groups as (select s.recording, s.frame, s.keypoint, s.camera, s.instance, k.group_id::bigint as group_id from scored s join kept k using (recording, frame, keypoint, low) where fine)"""
GA = """ga as (select g.recording, g.frame, g.keypoint, g.group_id as child_group, h.group_id as parent_group, sum(al.logp) as affinity
  from groups g join al on al.recording = g.recording and al.frame = g.frame and al.keypoint = g.keypoint and al.camera = g.camera and al.instance = g.instance
  join groups h on h.recording = g.recording and h.frame = g.frame and h.keypoint = g.keypoint - 1 and h.camera = g.camera and h.instance = al.parent_instance where g.keypoint > 0 group by all)"""
GI = """gi as (select g.recording, g.frame, g.keypoint, g.group_id, il.animal, sum(il.logp) as identity from groups g
  join il using (recording, frame, keypoint, camera, instance) group by all)"""
PEAKS = """pk as (select recording, camera, frame, keypoint, keypoint * 2 + instance as peak, x, y, round(confidence, 6) as confidence from det where x is not null),
best as (select *, row_number() over (partition by recording, camera, frame, keypoint order by confidence desc, peak desc) - 1 as instance from pk)"""
POSES = """poses as (select a.frame * 2 + a.instance as pose_id, a.keypoint, a.x, a.y, b.y as z from det a join det b using (frame, instance, keypoint) where a.camera = 0 and b.camera = 1)"""
BONES = f"""{POSES},
bones as (select c.pose_id, c.keypoint, c.x - p.x as dx, c.y - p.y as dy, c.z - p.z as dz, sqrt((c.x - p.x)**2 + (c.y - p.y)**2 + (c.z - p.z)**2) as length from poses c join poses p on p.pose_id = c.pose_id and p.keypoint = c.keypoint - 1),
whole as (select * from bones where pose_id in (select pose_id from bones group by 1 having count(length) = 3))"""
FILTER = f"""{BONES},
lim as (select keypoint, quantile_cont(length, 0.01) as low, quantile_cont(length, 0.99) as high from whole group by 1),
inner_ as (select * from whole where pose_id not in (select pose_id from whole join lim using (keypoint) where length < low or length > high)),
stats as (select keypoint, avg(length) as mean, stddev_pop(length) as std from inner_ group by 1)"""


def _lse(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


def decode(ids: str, edges: str, key: str, tag: str = "", seed: int | None = None) -> str:
    """CTEs that end in `tree` (key, p0 .. p3, total): ids (key, keypoint, i, a, logp), edges (key, keypoint, i, j, logp).

    With a seed the choices are samples: scores plus Gumbel noise from a generator that starts at the view's digest.
    """
    k4 = range(4)
    cells = ", ".join(f"coalesce(sum(logp) filter (keypoint = {k} and i = {i} and a = {a}), 0) as s{k}{i}{a}" for k in k4 for i in (0, 1) for a in (0, 1))
    links = ", ".join(f"coalesce(sum(logp) filter (keypoint = {k} and i = {i} and j = {j}), 0) as f{k}{i}{j}" for k in k4 for i in (0, 1) for j in (0, 1))
    own = ", ".join(f"s{k}00 + s{k}11 as o{k}0, s{k}10 + s{k}01 as o{k}1" for k in k4)
    cliques = ", ".join(f"coalesce(f{k}00 + f{k}11, 0) as c{k}00, coalesce(f{k}01 + f{k}10, 0) as c{k}01" for k in k4)
    norm = ", ".join(f"{_lse(f'o{k}0', f'o{k}1')} as n{k}, {_lse(f'c{k}00', f'c{k}01')} as z{k}" for k in k4)
    marg = ", ".join(f"o{k}{p} - n{k} as m{k}{p}" for k in k4 for p in (0, 1))
    # with two animals both normalisations are the same: the clique depends on whether child and parent agree
    rows = ", ".join(f"c{k}00 - z{k} as r{k}0, c{k}01 - z{k} as r{k}1" for k in k4)
    out = [
        f"wi{tag} as (select {key}, {cells} from {ids} group by {key})",
        f"we{tag} as (select {key}, {links} from {edges} group by {key})",
        f"w0{tag} as (select {key}, {own}, {cliques} from wi{tag} left join we{tag} using ({key}))",
        f"w1{tag} as (select *, {norm} from w0{tag})",
        f"w2{tag} as (select *, {marg}, {rows} from w1{tag})",
        f"u3{tag} as (select *, m30 as b30, m31 as b31 from w2{tag})",
    ]
    for k in (3, 2, 1):
        up = ", ".join(f"m{k - 1}{p} + {_lse(f'(r{k}{p} + b{k}0)', f'(r{k}{1 - p} + b{k}1)')} as b{k - 1}{p}" for p in (0, 1))
        out.append(f"u{k - 1}{tag} as (select *, {up} from u{k}{tag})")

    def score(k: int, p: int) -> str:
        own = f"b{k}{p}" if k == 0 else f"b{k}{p} + case when p{k - 1} = {p} then r{k}0 else r{k}1 end"
        if seed is None:
            return f"round({own}, 9)"
        return f"{own} - ln(-ln((s0 * {pow(LEHMER, 2 * k + p + 1, PRIME)} % {PRIME})::double / {PRIME}))"

    first = "" if seed is None else f"('0x' || substr(md5(concat_ws('|', {key}, {seed})), 1, 12))::bigint % {PRIME - 1} + 1 as s0, "
    out.append(f"n0{tag} as (select {first}* from u0{tag})")
    out.append(f"d0{tag} as (select *, case when {score(0, 1)} > {score(0, 0)} then 1 else 0 end as p0 from n0{tag})")
    for k in (1, 2, 3):
        out.append(f"d{k}{tag} as (select *, case when {score(k, 1)} > {score(k, 0)} then 1 else 0 end as p{k} from d{k - 1}{tag})")
    total = " + ".join([f"n{k} + case when p{k} = 0 then m{k}0 else m{k}1 end" for k in k4] + [f"case when p{k} = p{k - 1} then r{k}0 else r{k}1 end" for k in (1, 2, 3)])
    out.append(f"tree{tag} as (select {key}, p0, p1, p2, p3, {total} - ln(2) as total from d3{tag})")
    return ",\n".join(out)


def assigned(key: str, tag: str = "") -> str:
    return f"""asg{tag} as (select {key}, k::bigint as keypoint, a::bigint as animal, case when [p0, p1, p2, p3][k + 1] = 0 then a else 1 - a end::bigint as instance
  from tree{tag}, (select unnest([0, 1, 2, 3]) as k), (select unnest([0, 1]) as a))"""


VIEWS = f"""{E}, {ID}, {AF},
vi as (select recording, frame, camera, keypoint, instance as i, animal as a, logp from il),
ve as (select recording, frame, camera, keypoint, instance as i, parent_instance as j, logp from al)"""
VIEW_TREE = f"{VIEWS}, {decode('vi', 've', 'recording, frame, camera')}, {assigned('recording, frame, camera')}"
GRAPH = f"{E}, {ID}, {JS}, {PAIRS}"
S = "recording, camera, keypoint, instance"


def _undistort() -> str:
    lens = {c: views.intrinsics(c) for c in range(views.C)}
    pick = lambda name: "case camera " + " ".join(f"when {c} then {v[name]!r}::double" for c, v in lens.items()) + " end"
    out = [f"u0 as (select *, {', '.join(f'{pick(n)} as {n}' for n in lens[0])} from det)", "s0 as (select *, (x - cx) / fx as x0, (y - cy) / fy as y0, (x - cx) / fx as u, (y - cy) / fy as v from u0)"]
    for k in range(5):
        r, q = "(u * u + v * v)", "(1 + ((k3 * (u * u + v * v) + k2) * (u * u + v * v) + k1) * (u * u + v * v))"
        out.append(f"s{k + 1} as (select * exclude (u, v), (x0 - (2 * p1 * u * v + p2 * ({r} + 2 * u * u))) / {q} as u, (y0 - (p1 * ({r} + 2 * v * v) + 2 * p2 * u * v)) / {q} as v from s{k})")
    return f"with {E}, {', '.join(out)} select {S}, frame, round(u * fx + cx, 6) + 0.0 as x, round(v * fy + cy, 6) + 0.0 as y from s5"


def _filled() -> str:
    """CTE `fil`: detections with interpolated coordinates."""
    w = f"over (partition by {S} order by frame"
    ends = ", ".join(
        f"last_value(case when x is not null then {c} end ignore nulls) {w} rows between unbounded preceding and current row) as b_{c}, first_value(case when x is not null then {c} end ignore nulls) {w} rows between current row and unbounded following) as a_{c}"
        for c in ("frame", "x", "y")
    )
    line = lambda c: f"case when b_frame is null then a_{c} when a_frame is null or a_frame = b_frame then b_{c} else b_{c} + (a_{c} - b_{c}) * (frame - b_frame)::double / (a_frame - b_frame) end as {c}"
    return f"wide as (select *, {ends} from det), fil as (select {S}, frame, {line('x')}, {line('y')} from wide)"


def _centroids(sigma: int = 10) -> str:
    """Medians of interpolated coordinates; beyond its ends a recording goes on in reverse."""
    w = f"exp(-(o * o) / {2.0 * sigma * sigma})"
    mean = lambda m, c: f"round(sum({w} * {m}) / sum({w}) filter ({m} is not null), 6) + 0.0 as {c}"
    return f"""with {E}, {_filled()}, m as (select recording, camera, frame, median(x) as mx, median(y) as my from fil group by all),
n as (select *, min(frame) over v as first, max(frame) over v - min(frame) over v + 1 as long from m window v as (partition by recording, camera)),
p as (select recording, camera, frame, first, long, o, ((frame - first + o) % (2 * long) + 2 * long) % (2 * long) as k from n, (select unnest(generate_series({-4 * sigma}, {4 * sigma})) as o)),
q as (select *, first + case when k >= long then 2 * long - 1 - k else k end as at from p)
select q.recording, q.camera, q.frame, {mean("m.mx", "cx")}, {mean("m.my", "cy")}
from q left join m on m.recording = q.recording and m.camera = q.camera and m.frame = q.at group by all"""


def _points(source: str, key: str) -> str:
    """CTE `pts` (key, X, Y, Z, W): unit homogeneous points that fit rays best in a rectified rig.

    source has a row a ray: key, u, v (pixels from the centre) and t (the camera's shift in pixels). The
    point is the eigenvector of the least eigenvalue of a 4 by 4 matrix, found by inverse
    iteration; X and Y are eliminated first, as they don't meet in the matrix.
    """
    shift, step = 1e-3, 70
    solve = "(s33 * (Z - m02 * X / a - m12 * Y / a) - s23 * (W - m03 * X / a)) / det as z1, (s22 * (W - m03 * X / a) - s23 * (Z - m02 * X / a - m12 * Y / a)) / det as w1"
    return f"""mat as (select {key}, 90000.0 * count(*) + {shift} as a, -300 * sum(u) as m02, -300 * sum(t) as m03, -300 * sum(v) as m12, sum(u * u + v * v) + {shift} as m22, sum(u * t) as m23, sum(t * t) + {shift} as m33
  from {source} group by {key} having count(*) > 1),
sch as (select *, m22 - (m02 * m02 + m12 * m12) / a as s22, m23 - m02 * m03 / a as s23, m33 - m03 * m03 / a as s33, row_number() over () as no from mat),
con as (select *, s22 * s33 - s23 * s23 as det from sch),
itr as (select no, 0 as step, 1.0::double as X, 0.7::double as Y, 1.3::double as Z, 0.4::double as W from con
  union all
  select no, step + 1, x2 / norm, y2 / norm, z1 / norm, w1 / norm from (select *, sqrt(x2 * x2 + y2 * y2 + z1 * z1 + w1 * w1) as norm from
    (select *, (X - m02 * z1 - m03 * w1) / a as x2, (Y - m12 * z1) / a as y2 from (select no, step, X, Y, a, m02, m03, m12, {solve} from itr join con using (no) where step < {step})))),
pts as (select con.*, X, Y, Z, W from itr join con using (no) where step = {step})"""


def _pair_errors() -> str:
    key = "recording, frame, keypoint, cam1, inst1, cam2, inst2"
    pixel = lambda k: f"sqrt(power((300 * X - t{k} * W) / nullif(Z, 0) - u{k}, 2) + power(300 * Y / nullif(Z, 0) - v{k}, 2))"
    return f"""with recursive {GRAPH},
two as (select p.*, a.x - 245 as u1, a.y - 50 as v1, 150.0 * cam1 as t1, b.x - 245 as u2, b.y - 50 as v2, 150.0 * cam2 as t2 from pairs p
  join det a on a.recording = p.recording and a.frame = p.frame and a.keypoint = p.keypoint and a.camera = cam1 and a.instance = inst1
  join det b on b.recording = p.recording and b.frame = p.frame and b.keypoint = p.keypoint and b.camera = cam2 and b.instance = inst2),
ray as (select {key}, u1 as u, v1 as v, t1 as t from two union all select {key}, u2, v2, t2 from two),
{_points("ray", key)}
select {key}, round(({pixel(1)} + {pixel(2)}) / 2, 4) + 0.0 as error, round(divergence, 6) + 0.0 as divergence from two join pts using ({key})"""


def _triangulated() -> str:
    key = "recording, frame, keypoint, animal"
    return f"""with recursive {VIEW_TREE},
ray as (select {key}, x - 245 as u, y - 50 as v, 150.0 * camera as t from det join asg using (recording, frame, camera, keypoint, instance) where x is not null and y is not null),
{_points("ray", key)}
select {key}, round(X / Z, 4) + 0.0 as bearing_x, round(Y / Z, 4) + 0.0 as bearing_y, round(W / Z, 4) + 0.0 as inverse_depth from pts where abs(W) > {FAR} and Z <> 0"""


_PROJECTS = """ev as (select event_id, user_id as project, missing, floor(value)::bigint as v from e),
own as (select project, event_id % 6 + 1 as b, arg_min(v, event_id) as v from ev where not missing group by all),
raw as (select project, b as place, v % b as a, b from own union all select project, event_id + 100, event_id % 5, v % 8 from ev where missing and event_id % 7 = 0),
edg as (select project, least(a, b) as a, greatest(a, b) as b, min(place) as place, count(*) as times from raw group by all),
pro as (select distinct project, project % 7 as root from ev),
nbr as (select project, a as node, b as next, place from edg union all select project, b, a, place from edg),
rea as (select project, root as node from pro union select r.project, next from rea r join nbr using (project, node) where next < 7),
chk as (select project, root, 7::bigint as n_parts, (select count(*) from edg where edg.project = pro.project)::bigint as n_edges, (select count(*) from rea where rea.project = pro.project)::bigint as n_reached,
  coalesce((select max(times) > 1 from edg where edg.project = pro.project), false) as repeated, coalesce((select max(b) > 6 from edg where edg.project = pro.project), false) as unknown,
  (select count(*) from edg where edg.project = pro.project and a in (select node from rea where rea.project = edg.project)) as inside from pro),
chd as (select project, root, n_parts, n_edges, n_reached, repeated, unknown, inside >= n_reached as cycle, not repeated and not unknown and inside < n_reached and n_reached = 7 as valid from chk)"""


def _robust() -> str:
    """Medians over the points of each two cameras."""
    key = "recording, frame, keypoint, animal"
    pair = f"{key}, c1, c2"
    return f"""with recursive {VIEW_TREE},
see as (select {key}, camera, x - 245 as u, y - 50 as v, 150.0 * camera as t from det join asg using (recording, frame, camera, keypoint, instance) where x is not null and y is not null),
two as (select a.*, a.camera as c1, b.camera as c2, b.u as bu, b.v as bv, b.t as bt from see a join see b using ({key}) where a.camera < b.camera),
ray as (select {pair}, u, v, t from two union all select {pair}, bu, bv, bt from two),
{_points("ray", pair)},
med as (select {key}, median(X / W) as x, median(Y / W) as y, median(Z / W) as z from pts where abs(W) > {FAR} group by all)
select {key}, round(x / z, 4) + 0.0 as bearing_x, round(y / z, 4) + 0.0 as bearing_y, round(1 / z, 4) + 0.0 as inverse_depth from med where z <> 0"""


BODY = "recording, camera, animal"


def _bodies() -> str:
    """CTE `bod`: bodies (BODY, frame) where they are seen, wide: x0 .. y3, ox0 .., p0 .., heading h, state."""
    k4, w = range(4), "over (partition by recording, camera, animal, keypoint order by frame"
    ends = ", ".join(
        f"last_value(case when good then {c} end ignore nulls) {w} rows between unbounded preceding and current row) as b_{c}, first_value(case when good then {c} end ignore nulls) {w} rows between current row and unbounded following) as a_{c}"
        for c in ("frame", "x", "y")
    )
    line = lambda c: f"case when b_frame is null then a_{c} when a_frame is null or a_frame = b_frame then b_{c} else b_{c} + (a_{c} - b_{c}) * (frame - b_frame)::double / (a_frame - b_frame) end as f{c}"
    wide = ", ".join(f"coalesce(max(f{c}) filter (keypoint = {k}), avg(f{c})) as {c}{k}, max({c}) filter (keypoint = {k}) as o{c}{k}" for k in k4 for c in "xy")
    out = ", ".join(f"max(outlier_prob) filter (keypoint = {k}) as p{k}" for k in k4)
    bones = ", ".join(f"(x{k} - x{k - 1}) as dx{k}, (y{k} - y{k - 1}) as dy{k}, sqrt((x{k} - x{k - 1}) ** 2 + (y{k} - y{k - 1}) ** 2) + 1e-12 as r{k}" for k in (1, 2, 3))
    own = lambda k: (f"((cos(h) * dx{k} + sin(h) * dy{k}) / r{k})", f"((cos(h) * dy{k} - sin(h) * dx{k}) / r{k})")
    logs = [" + ".join(f"{kappa!r} * ({own(k)[0]} * {mu[0]!r} + {own(k)[1]} * {mu[1]!r}) + {log_norm(kappa, 2)!r}" for k, (mu, kappa) in state["bones"].items()) for state in FLAT_MIXTURE]
    return f"""loc as (select recording, camera, animal, keypoint, frame, x, y, outlier_prob, x is not null and y is not null and outlier_prob <= 0.5 as good from op join asg using (recording, frame, camera, keypoint, instance)),
fil as (select *, {line("x")}, {line("y")} from (select *, {ends} from loc)),
wid as (select {BODY}, frame, {wide}, {out} from fil group by all having avg(fx) is not null),
hed as (select *, case when y0 - y3 = 0 and x0 - x3 < 0 then -pi() else atan2(y0 - y3, x0 - x3 + 1e-10) end as h from wid),
bon as (select *, {bones} from hed),
wei as (select *, {logs[0]} as w0, {logs[1]} as w1 from bon),
bod as (select *, case when w1 > w0 then 1 else 0 end as state from wei)"""


def _noise(number: int) -> str:
    return f"((s0 * {pow(LEHMER, number + 1, PRIME)} % {PRIME})::double / {PRIME})"


_SEEDED = f"('0x' || substr(md5(concat_ws('|', {BODY}, frame, 1)), 1, 12))::bigint % {PRIME - 1} + 1 as s0"


def _pose_positions(steps: int = 3, size: float = 0.5, inlier: float = 10.0, outlier: float = 1e6, motion: float = 5.0, spread: float = 400.0) -> str:
    """Hamiltonian Monte Carlo in SQL: frames of one parity within segments of one parity at a time, four times."""
    k4, xy = range(4), [f"{c}{k}" for k in range(4) for c in "xy"]
    mu = lambda k: [f"(case state when 0 then {a!r} else {b!r} end)" for a, b in zip(FLAT_MIXTURE[0]["bones"][k][0], FLAT_MIXTURE[1]["bones"][k][0], strict=True)]
    turned = ", ".join(f"cos(h) * {mu(k)[0]} - sin(h) * {mu(k)[1]} as mx{k}, sin(h) * {mu(k)[0]} + cos(h) * {mu(k)[1]} as my{k}, case state when 0 then {FLAT_MIXTURE[0]['bones'][k][1]!r} else {FLAT_MIXTURE[1]['bones'][k][1]!r} end as c{k}" for k in (1, 2, 3))
    normals = ", ".join(f"sqrt(-2 * ln({_noise(j)})) * cos(2 * pi() * {_noise(8 + j)}) as n{c}" for j, c in enumerate(xy))
    state = ["recording", "camera", "animal", "frame", *xy, *[f"o{c}" for c in xy], *[f"p{k}" for k in k4], *[f"{c}{k}" for k in (1, 2, 3) for c in ("mx", "my", "c")], *[f"n{c}" for c in xy], "lu"]
    out = [f"st0 as materialized (select {BODY}, frame, {', '.join(xy)}, {', '.join('o' + c for c in xy)}, {', '.join(f'p{k}' for k in k4)}, {turned}, {normals}, ln({_noise(16)}) as lu from (select *, {_SEEDED} from bod))"]

    def density(of: str, to: str) -> None:
        """CTE `to`: all columns of `of` with d (log density) and g.. (its gradient) at the positions q.. ."""
        first = [f"qx{k} - ox{k} as ex{k}, qy{k} - oy{k} as ey{k}" for k in k4] + [f"qx{k} - qx{k - 1} as dx{k}, qy{k} - qy{k - 1} as dy{k}" for k in (1, 2, 3)]
        second = [f"ln(1 - p{k}) - ln(2 * pi() * {inlier}) - (ex{k} * ex{k} + ey{k} * ey{k}) / {2 * inlier} as la{k}, ln(p{k}) - ln(2 * pi() * {outlier}) - (ex{k} * ex{k} + ey{k} * ey{k}) / {2 * outlier} as lb{k}" for k in k4] + [f"sqrt(dx{k} * dx{k} + dy{k} * dy{k}) + 1e-12 as r{k}" for k in (1, 2, 3)]
        third = [f"{_lse(f'la{k}', f'lb{k}')} as l{k}" for k in k4] + [f"dx{k} / r{k} as ux{k}, dy{k} / r{k} as uy{k}" for k in (1, 2, 3)]
        fourth = [f"exp(la{k} - l{k}) / {inlier} + exp(lb{k} - l{k}) / {outlier} as f{k}" for k in k4] + [f"ux{k} * mx{k} + uy{k} * my{k} as s{k}" for k in (1, 2, 3)]
        fifth = [f"-(r{k} - {POSE_RADII[k]}) / {spread} * u{c}{k} + c{k} / r{k} * (m{c}{k} - s{k} * u{c}{k}) as a{c}{k}" for k in (1, 2, 3) for c in "xy"]
        pull = lambda c, k: f"coalesce(-e{c}{k} * f{k}, 0)" + (f" + a{c}{k}" if k else "") + (f" - a{c}{k + 1}" if k < 3 else "") + "".join(f" - coalesce(q{c}{k} - {side}{c}{k}, 0) / {motion}" for side in "vw")
        total = " + ".join([f"coalesce(l{k}, 0)" for k in k4] + [f"c{k} * s{k} - (r{k} - {POSE_RADII[k]}) ** 2 / {2 * spread}" for k in (1, 2, 3)]) + "".join(f" - coalesce((q{c} - {side}{c}) ** 2, 0) / {2 * motion}" for c in xy for side in "vw")
        kept = [*state, *[f"{x}{c}" for x in "qvwi" for c in xy], "h0"]
        held = of
        for name, cells in zip("abcde", (first, second, third, fourth, fifth), strict=True):
            out.append(f"{to}{name} as (select *, {', '.join(cells)} from {held})")
            held = to + name
        out.append(f"{to} as (select {', '.join(kept)}, {total} as d, {', '.join(f'{pull(c[0], int(c[1]))} as g{c}' for c in xy)} from {held})")

    for q, (half, parity) in enumerate(((0, 0), (0, 1), (1, 0), (1, 1))):
        who = f"frame // {POSE_SEGMENT} % 2 = {half} and frame % 2 = {parity}"
        side = lambda t, shift: f"left join st{q} {t} on {t}.recording = s.recording and {t}.camera = s.camera and {t}.animal = s.animal and {t}.frame = s.frame {shift}"
        near = f"select s.*, {', '.join(f's.{c} as q{c}, v.{c} as v{c}, w.{c} as w{c}' for c in xy)} from (select * from st{q} where {who}) s {side('v', '- 1')} {side('w', '+ 1')}"
        out.append(f"near{q} as ({near})")
        held = [*state, *[f"{x}{c}" for x in "vw" for c in xy]]
        out.append(f"g{q}_s as (select *, {', '.join(f'n{c} as i{c}' for c in xy)}, 0.0 as h0 from near{q})")
        density(f"g{q}_s", f"g{q}_0")
        kick = lambda c, share: f"i{c} + {size * share} * g{c}"
        square = lambda of: " + ".join(f"{of(c)} ** 2" for c in xy)
        out.append(f"m{q}_0 as (select {', '.join(held)}, {', '.join('q' + c for c in xy)}, {', '.join(f'{kick(c, 0.5)} as i{c}' for c in xy)}, d - ({square(lambda c: 'i' + c)}) / 2 as h0 from g{q}_0)")
        for step in range(steps):
            out.append(f"x{q}_{step} as (select {', '.join(held)}, {', '.join(f'q{c} + {size} * i{c} as q{c}' for c in xy)}, {', '.join('i' + c for c in xy)}, h0 from m{q}_{step})")
            density(f"x{q}_{step}", f"g{q}_{step + 1}")
            share = 1 if step + 1 < steps else 0.5
            out.append(f"m{q}_{step + 1} as (select {', '.join(held)}, {', '.join('q' + c for c in xy)}, {', '.join(f'{kick(c, share)} as i{c}' for c in xy)}, h0, d from g{q}_{step + 1})")
        fine = f"lu < d - ({square(lambda c: 'i' + c)}) / 2 - h0"
        rest = [c for c in state if c not in xy]
        out.append(f"st{q + 1} as materialized (select {', '.join(rest)}, {', '.join(f'case when {fine} then q{c} else {c} end as {c}' for c in xy)} from m{q}_{steps} union all by name select {', '.join(state)} from st{q} where not ({who}))")
    cells = ", ".join(f"{{'keypoint': {k}::bigint, 'x': x{k}, 'y': y{k}}}" for k in k4)
    return f"""with {VIEW_TREE}, {_bodies()},
{", ".join(out)}
select {BODY}, frame, e.keypoint, round(e.x, 4) + 0.0 as x, round(e.y, 4) + 0.0 as y from (select {BODY}, frame, unnest([{cells}]) as e from st4)"""


def _pose_states() -> str:
    """Sums over paths through segments, states at their ends drawn backwards by these, and those within by filtering from the end before."""
    moves = [[0.9, 0.1], [0.2, 0.8]]
    log = lambda i, j: repr(math.log(moves[i][j]))
    step = lambda j: f"n.w{j} + {_lse(f'(t.a0 + {log(0, j)})', f'(t.a1 + {log(1, j)})')}"
    draw = lambda a, b: f"case when n.u * (1 + exp(({b}) - ({a}))) >= 1 then 1 else 0 end"
    on = lambda *names: " and ".join(f"t.{c} = n.{c}" for c in ("recording", "camera", "animal", *names))
    after = lambda j: f"case t.state when 0 then {log(j, 0)} else {log(j, 1)} end"
    u = _noise(2 * 8 + 1 + 3 * TRIES)
    return f"""with recursive {VIEW_TREE}, {_bodies()},
see as (select {BODY}, frame, w0, w1, {u} as u, dense_rank() over (partition by {BODY} order by frame // {POSE_SEGMENT}) as seg, frame // {POSE_SEGMENT} as part from (select *, {_SEEDED} from bod)),
row as materialized (select *, row_number() over (partition by {BODY}, part order by frame) as no, count(*) over (partition by {BODY}, part) as many, max(seg) over (partition by {BODY}) as segs from see),
fwd as (select {BODY}, seg, no, i, w0 + case i when 0 then {log(0, 0)} else {log(1, 0)} end as a0, w1 + case i when 0 then {log(0, 1)} else {log(1, 1)} end as a1 from row, (select unnest([0, 1]) as i) where no = 1
  union all select t.recording, t.camera, t.animal, t.seg, n.no, t.i, {step(0)}, {step(1)} from fwd t join row n on {on("seg")} and n.no = t.no + 1),
mat as (select {BODY}, seg, any_value(u) as u, any_value(segs) as segs, max(a0) filter (i = 0) as m00, max(a1) filter (i = 0) as m01, max(a0) filter (i = 1) as m10, max(a1) filter (i = 1) as m11 from fwd join row using ({BODY}, seg, no) where no = many group by all),
fil2 as (select {BODY}, seg, {_lse("m00", "m10")} as f0, {_lse("m01", "m11")} as f1 from mat where seg = 1
  union all select n.recording, n.camera, n.animal, n.seg, {_lse("(t.f0 + n.m00)", "(t.f1 + n.m10)")}, {_lse("(t.f0 + n.m01)", "(t.f1 + n.m11)")} from fil2 t join mat n on {on()} and n.seg = t.seg + 1),
bnd as (select *, lead(m00) over w as l00, lead(m01) over w as l01, lead(m10) over w as l10, lead(m11) over w as l11 from fil2 join mat using ({BODY}, seg) window w as (partition by {BODY} order by seg)),
stp as (select {BODY}, seg, {draw("f0", "f1")} as state from bnd n where seg = segs
  union all select n.recording, n.camera, n.animal, n.seg, {draw("n.f0 + case t.state when 0 then n.l00 else n.l01 end", "n.f1 + case t.state when 0 then n.l10 else n.l11 end")} from stp t join bnd n on {on()} and n.seg = t.seg - 1),
ins as (select a.recording, a.camera, a.animal, a.seg, a.no, case when p.state is null then {_lse("a.a0", "b.a0")} when p.state = 0 then a.a0 else b.a0 end as g0, case when p.state is null then {_lse("a.a1", "b.a1")} when p.state = 0 then a.a1 else b.a1 end as g1
  from fwd a join fwd b using ({BODY}, seg, no) left join stp p on p.recording = a.recording and p.camera = a.camera and p.animal = a.animal and p.seg = a.seg - 1 where a.i = 0 and b.i = 1),
bck as (select {BODY}, seg, many as no, state from stp join (select distinct {BODY}, seg, many from row) using ({BODY}, seg)
  union all select n.recording, n.camera, n.animal, n.seg, n.no, {draw(f"n.g0 + {after(0)}", f"n.g1 + {after(1)}")} from bck t join (select * from ins join row using ({BODY}, seg, no)) n on {on("seg")} and n.no = t.no - 1)
select {BODY}, frame, state::bigint as state from bck join row using ({BODY}, seg, no)"""


def _space(mixture: str) -> str:
    """Tracks in space, seen again in each camera."""
    key = "recording, frame, keypoint, animal"
    return f"""with recursive {VIEW_TREE},
ray as (select {key}, x - 245 as u, y - 50 as v, 150.0 * camera as t from det join asg using (recording, frame, camera, keypoint, instance) where x is not null and y is not null),
{_points("ray", key)},
trk as (select {key}, avg(X / W) over w as sx, avg(Y / W) over w as sy, avg(Z / W) over w as sz from pts where abs(W) > {FAR} window w as (partition by recording, keypoint, animal order by frame range between 5 preceding and 5 following)),
mot as (select o.*, t.animal, o.x - (300 * sx + 245 * sz - 150 * o.camera) / nullif(sz, 0) as ex, o.y - (300 * sy + 50 * sz) / nullif(sz, 0) as ey from op o join trk t using (recording, frame, keypoint))
select recording, camera, keypoint, instance, frame, animal, round(coalesce({mixture}, 0), 2) + 0.0 as logp from mot"""


def _smoothed(eta: float = 10.0) -> str:
    """Viterbi forwards and back by recursion over the frames of a camera."""
    step = "ln((exp(c{k} - top) + 1e-6) / (exp(c0 - top) + exp(c1 - top) + 2e-6))"
    same, other = step.format(k=0), step.format(k=1)
    view = "recording, camera, frame"
    return f"""with recursive {VIEW_TREE}, {_filled()},
loc as (select {view}, keypoint, animal, x, y from fil join asg using (recording, frame, camera, keypoint, instance)),
mov as (select {", ".join("a." + c for c in view.split(", "))}, coalesce(sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) filter (a.animal = b.animal), 0) as same, coalesce(sum((a.x - b.x) ** 2 + (a.y - b.y) ** 2) filter (a.animal <> b.animal), 0) as other
  from loc a join loc b on b.recording = a.recording and b.camera = a.camera and b.frame = a.frame - 1 and b.keypoint = a.keypoint group by all),
own as (select {view}, coalesce(sum(logp) filter (il.animal = asg.animal), 0) as e0, coalesce(sum(logp) filter (il.animal <> asg.animal), 0) as e1 from asg join il using (recording, frame, camera, keypoint, instance) group by all),
cst as (select {view}, e0, e1, -coalesce(same, 0) / {eta} as c0, -coalesce(other, 0) / {eta} as c1, greatest(-coalesce(same, 0) / {eta}, -coalesce(other, 0) / {eta}) as top, row_number() over (partition by recording, camera order by frame) as no from own left join mov using ({view})),
stp as (select {view}, no, e0, e1, {same} as s, {other} as d from cst),
vit as (select recording, camera, frame, no, greatest(s, d) + e0 as t0, greatest(s, d) + e1 as t1, 0 as b0, 0 as b1 from stp where no = 1
  union all
  select n.recording, n.camera, n.frame, n.no, greatest(v.t0 + n.s, v.t1 + n.d) + n.e0, greatest(v.t0 + n.d, v.t1 + n.s) + n.e1, case when v.t1 + n.d > v.t0 + n.s then 1 else 0 end, case when v.t1 + n.s > v.t0 + n.d then 1 else 0 end
  from vit v join stp n on n.recording = v.recording and n.camera = v.camera and n.no = v.no + 1),
bck as (select recording, camera, frame, no, case when t1 > t0 then 1 else 0 end as p, b0, b1 from vit where (recording, camera, no) in (select recording, camera, max(no) from vit group by 1, 2)
  union all
  select v.recording, v.camera, v.frame, v.no, case when b.p = 0 then b.b0 else b.b1 end, v.b0, v.b1 from bck b join vit v on v.recording = b.recording and v.camera = b.camera and v.no = b.no - 1)
select recording, camera, frame, p::bigint as p from bck"""


def _gibbs(mixture: str) -> str:
    """One sweep: tracks from the best identities, their likelihood added, and a sample down the tree."""
    key = "recording, frame, camera"
    return f"""with {VIEW_TREE},
loc as (select recording, frame, camera, keypoint, animal, x, y from det join asg using (recording, frame, camera, keypoint, instance)),
trk as (select recording, frame, camera, keypoint, animal, avg(x) over w as tx, avg(y) over w as ty from loc window w as (partition by recording, camera, keypoint, animal order by frame range between 5 preceding and 5 following)),
mot as (select recording, frame, camera, keypoint, instance, animal, coalesce({mixture}, 0) as motion from (select o.*, t.animal, t.tx, t.ty, o.x - t.tx as ex, o.y - t.ty as ey from op o join trk t using (recording, frame, camera, keypoint))),
jnt as (select {key}, keypoint, instance as i, il.animal as a, logp + coalesce(motion, 0) as logp from il left join mot using (recording, frame, camera, keypoint, instance, animal)),
{decode("jnt", "ve", key, "s", 1)}, {assigned(key, "s")} select * from asgs"""


def _movmf(mixture: list[dict]) -> str:
    def log_norm(kappa: float) -> float:
        return math.log(kappa / (2 * math.pi * (1 - math.exp(-2 * kappa)))) - kappa

    def density(state: dict) -> str:
        cases = " ".join(f"when {k} then {log_norm(kappa)!r} + {kappa!r} * (x * {mu[0]!r} + y * {mu[1]!r} + z * {mu[2]!r})" for k, (mu, kappa) in state["bones"].items())
        return f"sum(case keypoint {cases} end) + {math.log(state['pi'])!r}"

    return f"""with {E}, {BONES}, units as (select pose_id, keypoint, dx / (length + 1e-16) as x, dy / (length + 1e-16) as y, dz / (length + 1e-16) as z from whole),
l as (select pose_id, {density(mixture[0])} as l0, {density(mixture[1])} as l1 from units group by 1),
t as (select *, {_lse("l0", "l1")} as total from l),
r as (select u.*, s.state, total, exp(case s.state when 0 then l0 else l1 end - total) as r from units u join t using (pose_id), (select unnest([0, 1])::bigint as state) s),
g as (select state, keypoint, sum(r) as n, sum(r * x) as sx, sum(r * y) as sy, sum(r * z) as sz, count(*) as poses, avg(total) as ll from r group by all),
h as (select *, sqrt(sx * sx + sy * sy + sz * sz) as long, least(sqrt(sx * sx + sy * sy + sz * sz) / greatest(n, 1e-12), 1 - 1e-9) as rbar from g)
select state, keypoint, round(n / poses, 6) + 0.0 as pi, round(sx / greatest(long, 1e-12), 6) + 0.0 as mu_x, round(sy / greatest(long, 1e-12), 6) + 0.0 as mu_y, round(sz / greatest(long, 1e-12), 6) + 0.0 as mu_z,
  round(rbar * (3 - rbar * rbar) / (1 - rbar * rbar), 6) + 0.0 as kappa, round(ll, 6) + 0.0 as log_likelihood from h"""


def _kmeans(k: int = 8, starts: int = 10, steps: int = 100, tol: float = 1e-4) -> str:
    """Lloyd's algorithm by recursion, a row of state for each start and cluster; a start that stands still leaves it, and its centroids of the step before count."""
    return f"""with recursive pts as (select vec_id, embedding::double[] as v from embeddings where embedding is not null),
ini as (select s, c, v from (select s, row_number() over (partition by s order by md5(concat_ws('|', s, vec_id)), vec_id) - 1 as c, v from pts, (select unnest(generate_series(0, {starts - 1})) as s)) where c < {k}),
run as (select s, 0 as step, c, v as cen, 'inf'::double as last, 'inf'::double as inertia from ini
  union all
  select s, step + 1, c, list(m order by d), any_value(inertia), any_value(total) from (
    select s, step, c, d, any_value(inertia) as inertia, any_value(total) as total, coalesce(avg(val) filter (rn = 1), 0) as m from (
      select s, step, c, inertia, rn, sum(far) filter (rn = 1) over (partition by s) as total, unnest(v) as val, generate_subscripts(v, 1) as d from (
        select r.s, r.step, r.c, r.inertia, p.v, power(list_distance(r.cen, p.v), 2) as far, row_number() over (partition by r.s, p.vec_id order by list_distance(r.cen, p.v), r.c) as rn
        from run r, pts p where r.step < {steps} and (r.step = 0 or abs(r.last - r.inertia) >= {tol} or r.last = 'inf'::double))) group by all) group by s, step, c),
fin as (select s, max(step) as step, arg_max(inertia, step) as inertia, abs(arg_max(last, step) - arg_max(inertia, step)) < {tol} as still from run group by s),
won as (select s, step - still::int as step from fin order by round(inertia, 6), s limit 1)
select vec_id, c::bigint as cluster from (select p.vec_id, r.c, row_number() over (partition by p.vec_id order by list_distance(r.cen, p.v), r.c) as rn from run r join won using (s, step), pts p) where rn = 1"""


def oracle_sql() -> dict[str, str]:
    gauss = lambda v: f"(-ln(2 * pi() * {v}) - (x - y) * (x - y) / (2 * {v}))"
    mix_a, mix_b = f"(ln(1 - outlier_prob) + {gauss('10.0')})", f"(ln(outlier_prob) + {gauss('1000000.0')})"
    cell = "recording, frame, keypoint"
    return {
        "scan_detections": f"with {E} select {S}, frame, x, y, round(confidence, 6) + 0.0 as confidence from det",
        "outlier_probs": f"with {E} select {S}, frame, round(outlier_prob, 6) + 0.0 as outlier_prob from op",
        "interpolate_keypoints": f"with {E}, {_filled()} select {S}, frame, round(x, 6) + 0.0 as x, round(y, 6) + 0.0 as y from fil",
        "affinity_logprobs": f"with {E}, {AF} select {S}, frame, parent_instance, round(logp, 6) + 0.0 as logp from al",
        "identity_logprobs": f"with {E}, {ID} select {S}, frame, animal, round(logp, 6) + 0.0 as logp from il",
        "topn_detections": f"with {E} select {S}, frame, 0::bigint as slot, round(confidence, 6) + 0.0 as confidence from det qualify row_number() over (partition by recording, frame, camera, keypoint order by confidence desc, instance desc) = 1",
        "sync_matched_frames": f"with {E} select {S}, frame - camera as frame, x, y from det where frame >= camera",
        "undistort": _undistort(),
        "jensen_shannon_pairs": f"with {E}, {ID}, {JS} select u.recording, u.frame, u.keypoint, u.camera as cam1, u.instance as inst1, v.camera as cam2, v.instance as inst2, round({_JSD}, 6) + 0.0 as divergence from pn u join pn v on u.recording = v.recording and u.frame = v.frame and u.keypoint = v.keypoint and u.camera > v.camera",
        "rectified_pair_scores": f"with {GRAPH} select {cell}, cam1, inst1, cam2, inst2, round(error, 6) + 0.0 as error, round(divergence, 6) + 0.0 as divergence from pairs",
        "pair_graph_edges": f"with {GRAPH} select {cell}, cam1, inst1, cam2, inst2 from edges",
        "components": f"with recursive {GRAPH}, {REACH} select {cell}, node // 2 as camera, node % 2 as instance, (dense_rank() over (partition by {cell} order by low) - 1)::bigint as component from comp",
        "filtered_groups": f"with recursive {GRAPH}, {GROUPS} select * from groups",
        "group_affinities": f"with recursive {GRAPH}, {AF}, {GROUPS}, {GA} select * replace (round(affinity, 6) + 0.0 as affinity) from ga",
        "group_identities": f"with recursive {GRAPH}, {GROUPS}, {GI} select * replace (round(identity, 6) + 0.0 as identity) from gi",
        "permutation_scores": f"with {E}, {ID} select recording, frame, camera, keypoint, p::bigint as p, round(coalesce(sum(logp) filter (animal = case when p = 0 then instance else 1 - instance end), 0), 6) + 0.0 as score from il, (select unnest([0, 1]) as p) group by all",
        "permutation_choice": f"with {E}, {ID}, s as (select recording, frame, camera, keypoint, coalesce(sum(logp) filter (animal = instance), 0) as s0, coalesce(sum(logp) filter (animal <> instance), 0) as s1 from il group by all) select recording, frame, camera, keypoint, case when round(s1, 9) > round(s0, 9) then 1 else 0 end::bigint as p from s",
        "clique_affinity": f"""with {E}, {AF}, s as (select recording, frame, camera, keypoint, coalesce(sum(logp) filter (instance = parent_instance), 0) as same, coalesce(sum(logp) filter (instance <> parent_instance), 0) as other from al group by all),
c as (select recording, frame, camera, keypoint, a::bigint as child_p, b::bigint as parent_p, case when a = b then same else other end as logp, {_lse("same", "other")} as z from s, (select unnest([0, 1]) as a), (select unnest([0, 1]) as b))
select recording, frame, camera, keypoint, child_p, parent_p, round(logp, 6) + 0.0 as logp, round(logp - z, 6) + 0.0 as row_norm, round(logp - z, 6) + 0.0 as col_norm from c""",
        "tree_decode": f"with {VIEW_TREE} select * from asg",
        "tree_loglik": f"with {VIEW_TREE} select recording, frame, camera, round(total, 6) + 0.0 as log_likelihood from tree",
        "split_by_animal": f"with {VIEW_TREE} select recording, frame, camera, keypoint, animal, instance, x, y from det join asg using (recording, frame, camera, keypoint, instance)",
        "pose_filter": f"with {E}, {FILTER} select * from poses where pose_id in (select pose_id from inner_ join stats using (keypoint) group by 1 having bool_and(abs(length - mean) < 3 * std))",
        "pose_stats": f"with {E}, {FILTER} select keypoint, round(mean, 6) + 0.0 as mean, round(std, 6) + 0.0 as std from stats",
        "standardize_poses": f"""with {E}, {POSES}, c as (select pose_id, keypoint, x - avg(x) over w as x, y - avg(y) over w as y, z - avg(z) over w as z,
  max(x) filter (keypoint = 0) over w - max(x) filter (keypoint = 3) over w as hx, max(y) filter (keypoint = 0) over w - max(y) filter (keypoint = 3) over w as hy from poses window w as (partition by pose_id)),
h as (select *, case when hy = 0 and hx < 0 then -pi() else atan2(hy, hx + 1e-10) end as t from c)
select pose_id, keypoint, round(x * cos(t) + y * sin(t), 6) + 0.0 as x, round(y * cos(t) - x * sin(t), 6) + 0.0 as y, round(z, 6) + 0.0 as z from h""",
        "pose_directions": f"with {E}, {BONES} select pose_id, keypoint, round(dx / (length + 1e-16), 6) + 0.0 as x, round(dy / (length + 1e-16), 6) + 0.0 as y, round(dz / (length + 1e-16), 6) + 0.0 as z from whole",
        "pose_windows": f"with {E}, {POSES}, m as (select pose_id, median(x) as x, median(y) as y from poses group by 1) select pose_id, round(x - 75, 6) + 0.0 as x_low, round(x + 75, 6) + 0.0 as x_high, round(y - 75, 6) + 0.0 as y_low, round(y + 75, 6) + 0.0 as y_high from m",
        "mixture_loglik": f"with {E} select {S}, frame, round(coalesce({_lse(mix_a, mix_b)}, 0), 6) + 0.0 as logp from op",
        "crop_centroids": _centroids(),
        "camera_pair_errors": _pair_errors(),
        "triangulated_points": _triangulated(),
        "tree_sample": f"with {VIEWS}, {decode('vi', 've', 'recording, frame, camera', seed=1)}, {assigned('recording, frame, camera')} select * from asg",
        "smoothed_permutations": _smoothed(),
        "space_loglik": _space(_lse(*(x.replace("(x - y) * (x - y)", "(ex * ex + ey * ey)") for x in (mix_a, mix_b)))),
        "gibbs_sweep": _gibbs(_lse(*(x.replace("(x - y) * (x - y)", "(ex * ex + ey * ey)") for x in (mix_a, mix_b)))),
        "movmf_step": _movmf(MIXTURE),
        "tree_decode_sql": f"with {VIEW_TREE} select * from asg",
        "camera_pairs_sql": f"""with {E} select u.recording, u.frame, u.keypoint, u.camera as cam1, u.instance as inst1, u.x as x1, u.y as y1, v.camera as cam2, v.instance as inst2, v.x as x2, v.y as y2
from det u join det v on u.recording = v.recording and u.frame = v.frame and u.keypoint = v.keypoint and u.camera > v.camera where u.x is not null and u.y is not null and v.x is not null and v.y is not null""",
        "best_assignments": f"""with {E}, {ID}, s as (select recording, frame, camera, keypoint, coalesce(sum(logp) filter (animal = instance), 0) as s0, coalesce(sum(logp) filter (animal <> instance), 0) as s1 from il group by all)
select recording, frame, camera, keypoint, a::bigint as animal, case when s1 > s0 then 1 - a else a end::bigint as instance, round(greatest(s0, s1), 6) + 0.0 as score from s, (select unnest([0, 1]) as a)""",
        "hdf5_detections": f"with {E} select recording, camera, keypoint, instance, frame, x, y, round(confidence, 6) + 0.0 as confidence from det where x is not null and y is not null",
        "skeleton_check": f"with recursive {E}, {_PROJECTS} select project, n_parts, n_edges, n_reached, repeated, unknown, cycle, valid from chd",
        "skeleton_order": f"""with recursive {E}, {_PROJECTS},
walk as (select project, root as part, root as above, [-1::bigint] as path from chd where valid
  union all select w.project, b.next, w.part, list_append(w.path, b.place) from walk w join nbr b on b.project = w.project and b.node = w.part and b.next <> w.above),
num as (select *, row_number() over (partition by project order by path) - 1 as keypoint from walk)
select n.project, n.keypoint::bigint as keypoint, n.part, m.keypoint::bigint as parent from num n join num m on m.project = n.project and m.part = n.above""",
        "robust_points": _robust(),
        "pose_positions": _pose_positions(),
        "pose_states": _pose_states(),
        "embedding_kmeans": _kmeans(),
        "composed_permutations": f"""with {E}, {ID}, s as (select recording, frame, camera, keypoint, coalesce(sum(logp) filter (animal = instance), 0) as s0, coalesce(sum(logp) filter (animal <> instance), 0) as s1 from il group by all),
b as (select recording, frame, camera, keypoint, case when round(s1, 9) > round(s0, 9) then 1 else 0 end as p from s)
select o.recording, o.frame, o.camera, o.keypoint, (f.p + o.p) % 2 ::bigint as p from b o join b f on f.recording = o.recording and f.frame = o.frame and f.keypoint = o.keypoint and f.camera = 0 where o.camera > 0""",
        "unequal_cameras": f"with {E}, f as (select recording, camera, max(frame) + 1 as frames from det where x is not null and y > 50 group by all) select recording, min(frames) as least, max(frames) as most from f group by 1 having min(frames) <> max(frames)",
        "sleap_detections": f"with {E}, {PEAKS} select recording, camera, frame, keypoint, instance, x, y, confidence from best",
        "sleap_affinities": f"""with {E}, {PEAKS},
eds as (select recording, camera, frame, edge, peak - 2 as pa, case when edge = 1 and frame % 7 = 0 then -1 else peak end as pb, round(((frame * 13 + peak * 5 + edge) % 31) / 31, 6) as score from (select *, keypoint * 2 + instance as peak from det where keypoint in (1, 2)), (select unnest([0, 1]) as edge)),
used as (select recording, camera, frame, pa, pb, arg_max(score, edge) as score from eds where pb >= 0 group by all)
select c.recording, c.camera, c.frame, c.keypoint, c.instance, p.instance as parent_instance, coalesce(u.score, 0.0)::double as weight from best c
  join best p on p.recording = c.recording and p.camera = c.camera and p.frame = c.frame and p.keypoint = c.keypoint - 1
  left join used u on u.recording = c.recording and u.camera = c.camera and u.frame = c.frame and u.pb = c.peak and u.pa = p.peak""",
        "overlay_segments": f"with {E}, o as (select * from det where x >= 0 and x < 80 and y >= 0 and y < 80) select c.recording, c.camera, c.frame, c.instance, c.keypoint, c.x, c.y, p.x as px, p.y as py from o c join o p on p.recording = c.recording and p.camera = c.camera and p.frame = c.frame and p.instance = c.instance and p.keypoint = c.keypoint - 1",
        "assignments_rectified": f"""with recursive {GRAPH}, {AF}, {GROUPS}, {GA}, {GI},
ti as (select recording, frame, keypoint, group_id as i, animal as a, identity as logp from gi),
te as (select recording, frame, keypoint, child_group as i, parent_group as j, affinity as logp from ga),
{decode("ti", "te", "recording, frame")}, {assigned("recording, frame")}
select g.recording, g.frame, g.keypoint, g.camera, g.instance, g.group_id, a.animal from groups g left join asg a on a.recording = g.recording and a.frame = g.frame and a.keypoint = g.keypoint and a.instance = g.group_id""",
    }
