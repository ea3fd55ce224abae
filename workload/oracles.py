"""SQL of the registered queries for an independent check in DuckDB."""

from __future__ import annotations

from typing import NamedTuple

from evenhand.functions.hashing import DEFAULT_PRIME, WIDE_PRIME, draw_rows
from evenhand.operators.kmeans import OVERSAMPLING, START_ROUNDS, TOLERANCE
from workload import fixtures as fx
from workload import queries as q

ORACLES: dict[str, str] = {}

LI = fx.sql_points_li()
THREE = fx.sql_points_three()


def add(key: str, sql: str) -> None:
    ORACLES[key] = sql


def center_rows(centers) -> str:
    rows = ", ".join(f"({i}, {', '.join(f'{v!r}::double' for v in c)})" for i, c in enumerate(centers))
    names = ", ".join(f"c{j}" for j in range(len(centers[0])))
    return f"select * from (values {rows}) t(cluster, {names})"


def sq(d: int) -> str:
    return " + ".join(f"(x{j} - c.c{j}) * (x{j} - c.c{j})" for j in range(d))


def assigned(points: str, centers: str, d: int) -> str:
    """Points with ``cluster`` and ``dist2``; ``points`` and ``centers`` are table names."""
    packed = ", ".join(f"'c{j}': c{j}" for j in range(d))
    listed = f"select list({{'i': cluster, {packed}}} order by cluster) as cs from {centers}"
    best = f"list_min(list_transform(cs, lambda c: {{'d': {sq(d)}, 'i': c.i}}))"
    return f"select p.*, best.i::int as cluster, best.d as dist2 from (select p.*, {best} as best from {points} p, ({listed})) p"


def with_assigned(points: str, centers, tail: str) -> str:
    d = len(centers[0])
    return (
        f"with pts as ({points}), c_0 as ({center_rows(centers)}), "
        f"a as materialized ({assigned('pts', 'c_0', d)}) {tail}"
    )


# Points: source, counts, objectives

add("points_from_text", f"select x0, x1, x2, g from ({LI})")
add(
    "points_permissive",
    f"""with s as (
        select x1, case when l_orderkey % 7 = 0 then 'empty label' when l_orderkey % 11 = 0 then 'wrong dimension'
            when l_orderkey % 13 = 0 then 'coordinate is not a finite number' else '' end as reason from ({LI})
    )
    select reason, count(*) as n, case when reason = '' then round(sum(x1), 3) else 0.0 end as sum_x1
    from s group by reason""",
)
add(
    "repartitioned_count",
    "select g, count(*) as n, round(sum(x0), 2) as sum_x0, round(sum(round(x1 * 1000, 2)), 2) as sum_x1, "
    f"round(sum(round(x2, 4)), 2) as sum_x2, 7::bigint as n_partitions from ({LI}) group by g",
)
add(
    "gen_group_counts",
    f"""with s as (select count(*) as n, count(*) * {q.GEN_PERC_A} // 100 as na from lineitem),
    b as (select n - na as nb, (n - na) // {q.GEN_K} as each_n from s),
    blobs as (
        select 'A' as g, 0 as blob, na as n from s
        union all
        select 'B', i::int, each_n + case when i = {q.GEN_K} then nb - {q.GEN_K} * each_n else 0 end
        from b, range(1, {q.GEN_K} + 1) r(i)
    )
    select g, blob, n::bigint as n from blobs where n > 0""",
)
add("group_filter", f"select {', '.join(fx.LI_KEY)}, g from ({LI}) where g = 'A'")
COUNTS = "count(*) as n, count(*) filter (g = 'A') as n_a, count(*) filter (g = 'B') as n_b"
add("group_counts", f"select {COUNTS} from ({LI})")
add("group_counts_three", f"select {COUNTS} from ({THREE})")
add("group_hist", f"select g, count(*) as n from ({THREE}) group by g")
c0 = fx.CENTERS_LI[0]
add(
    "sq_distance",
    f"select {', '.join(fx.LI_KEY)}, "
    + " + ".join(f"(x{j} - {v!r}::double) * (x{j} - {v!r}::double)" for j, v in enumerate(c0))
    + f" as d2 from ({LI})",
)
add(
    "assign_nearest",
    with_assigned(LI, fx.CENTERS_LI, f"select {', '.join(fx.LI_KEY)}, cluster, dist2 from a"),
)
DELTAS = (
    "coalesce(avg(dist2) filter (g = 'A'), 0.0::double) as delta_a, "
    "coalesce(avg(dist2) filter (g = 'B'), 0.0::double) as delta_b"
)
FAIR = (
    f"select round(delta_a, 6) as delta_a, round(delta_b, 6) as delta_b, "
    f"round(greatest(delta_a, delta_b), 6) as phi from (select {DELTAS} from a)"
)
STANDARD = "select round(coalesce(avg(dist2), 0.0::double), 6) as delta from a"
add("standard_objective", with_assigned(LI, fx.CENTERS_LI, STANDARD))
add("fair_objective", with_assigned(LI, fx.CENTERS_LI, FAIR))
add("fair_objective_three", with_assigned(THREE, fx.CENTERS_THREE, FAIR))
CLUSTER_COUNTS = (
    "select c_0.cluster::int as cluster, count(a.g) filter (a.g = 'A') as n_a, "
    "count(a.g) filter (a.g <> 'A') as n_b from c_0 left join a using (cluster) group by c_0.cluster"
)
add("cluster_group_counts", with_assigned(LI, fx.CENTERS_LI, CLUSTER_COUNTS))
add("cluster_group_counts_three", with_assigned(THREE, fx.CENTERS_THREE, CLUSTER_COUNTS))
add(
    "clustering_report",
    with_assigned(
        LI,
        fx.CENTERS_LI,
        f"select n, n_a, n_b, round(delta, 6) as delta, round(greatest(delta_a, delta_b), 6) as phi "
        f"from (select {COUNTS}, avg(dist2) as delta, {DELTAS} from a)",
    ),
)


def unpivot(table: str, columns: list[str], keys: str, digits: int) -> str:
    return " union all ".join(
        f"select {keys}, {j}::int as dim, round({c}, {digits}) as v from {table}" for j, c in enumerate(columns)
    )


add(
    "clustering_report_clusters",
    with_assigned(
        LI,
        fx.CENTERS_LI,
        f", n as ({CLUSTER_COUNTS}), r as (select n.*, c0, c1, c2 from n join c_0 using (cluster)) "
        + unpivot("r", ["c0", "c1", "c2"], "cluster, n_a, n_b", 4),
    ),
)

# Embeddings: long form, one row per coordinate; the centres are the label means

EMB = f"""with e as materialized (
    select vec_id, label, {fx.EMB_GROUP} as g, unnest(embedding)::double as v,
           generate_subscripts(embedding, 1) - 1 as j
    from embeddings),
c as (select label as cluster, j, avg(v) as m from e group by all),
near as (select vec_id, cluster, sum((v - m) * (v - m)) as d from e join c using (j) group by all),
a as materialized (
    select vec_id, g, cluster::int as cluster, dist2 from
    (select vec_id, arg_min(cluster, d) as cluster, min(d) as dist2 from near group by vec_id)
    join (select distinct vec_id, g from e) using (vec_id)),
moments as materialized (
    select cluster, g, j, count(*) as n, avg(v) as mean, var_pop(v) as var
    from a join (select vec_id, j, v from e) using (vec_id) group by all)
"""
add("assign_embeddings", EMB + "select vec_id, cluster, round(dist2, 6) as dist2 from a")
add("standard_objective_emb", EMB + STANDARD)
add("fair_objective_emb", EMB + FAIR)
add("cluster_group_means_emb", EMB + "select cluster, g, n, j::int as dim, round(mean, 6) as v from moments")
add(
    "cluster_group_spread_emb",
    EMB + "select cluster, g, any_value(n) as n, round(sum(n * var), 6) as spread from moments group by cluster, g",
)

# Group statistics and clustering rounds


def sides(d: int) -> str:
    """Moments of A and not-A per cluster, one row per (cluster, g); columns m0.., spread, n, n_exact."""
    means = ", ".join(f"avg(x{j}) as m{j}" for j in range(d))
    spread = " + ".join(f"var_pop(x{j})" for j in range(d))
    return (
        f"select cluster, case when g = 'A' then 'A' else 'B' end as g, count(*) as n, "
        f"count(*) filter (g in ('A', 'B')) as n_exact, {means}, count(*) * ({spread}) as spread from a group by 1, 2"
    )


SIDES = f", s as materialized ({sides(3)})"
add(
    "cluster_group_means",
    with_assigned(LI, fx.CENTERS_LI, f"{SIDES} " + unpivot("s", ["m0", "m1", "m2"], "cluster, g, n", 4)),
)
TEXT = "'(' || " + " || ',' || ".join(f"printf('%.4f', m{j})" for j in range(3)) + " || ')'"
add(
    "clustering_report_text",
    with_assigned(
        LI,
        fx.CENTERS_LI,
        f"{SIDES} select cluster, (sum(n) over (partition by cluster))::bigint as n, "
        f"{TEXT} as center from s qualify g = max(g) over (partition by cluster)",
    ),
)
FIXED = (
    "select round(coalesce(sum(spread) filter (g = 'A') / sum(n) filter (g = 'A'), 0), 6) as fixed_a, "
    "round(coalesce(sum(spread) filter (g = 'B') / sum(n_exact) filter (g = 'B'), 0), 6) as fixed_b from s"
)
add("fair_fixed_cost", with_assigned(LI, fx.CENTERS_LI, f"{SIDES} {FIXED}"))
add("fair_fixed_cost_three", with_assigned(THREE, fx.CENTERS_THREE, f", s as materialized ({sides(2)}) {FIXED}"))
add(
    "cluster_shares",
    with_assigned(
        LI,
        fx.CENTERS_LI,
        f"{SIDES} select cluster, g, round(n / sum(n_exact) over (partition by g), 6) as share from s",
    ),
)
add(
    "mean_gap",
    with_assigned(
        LI,
        fx.CENTERS_LI,
        f"{SIDES} select cluster, round(coalesce(sqrt((a.m0 - b.m0) * (a.m0 - b.m0) + (a.m1 - b.m1) * (a.m1 - b.m1) "
        "+ (a.m2 - b.m2) * (a.m2 - b.m2)), 0), 6) as ell "
        "from (select * from s where g = 'A') a full join (select * from s where g = 'B') b using (cluster)",
    ),
)


def start_of(points: str, centers) -> tuple[list[str], int]:
    """Tables ``pts`` and ``c_0``, and the dimension; ``centers`` are given, or the tables of a start with it."""
    if isinstance(centers, Start):
        return centers.ctes, centers.d
    return [f"pts as ({points})", f"c_0 as ({center_rows(centers)})"], len(centers[0])


class Start(NamedTuple):
    ctes: list[str]
    d: int


def draw_sql(seed: int, step, key: str = "key") -> str:
    return f"(('0x' || substr(md5('{seed}|{step}|' || {key}), 1, 13))::bigint::double / {2.0**52!r})"


def kmeans_start(points: str, d: int, k: int, seed: int) -> Start:
    """Tables of the parallel start: candidates by rounds, their weights, then one pick after the other."""
    xs, cs = ([f"{name}{j}" for j in range(d)] for name in "xc")
    key = " || ',' || ".join(f"{x}::varchar" for x in xs)
    renamed = ", ".join(f"{x} as {c}" for x, c in zip(xs, cs))
    ctes = [
        f"pts as materialized (select *, {key} as key from ({points}))",
        f"k_0 as materialized (select 0::bigint as cluster, {renamed}, key from pts "
        f"order by {draw_sql(seed, 0)}, {', '.join(xs)} limit 1)",
    ]
    for r in range(1, START_ROUNDS + 1):
        likely = f"{draw_sql(seed, r)} * (select sum(dist2) from s_{r}) < {OVERSAMPLING * k!r}::double * dist2"
        ctes += [
            f"s_{r} as materialized ({assigned('pts', f'k_{r - 1}', d)})",
            f"drawn_{r} as materialized (select distinct {', '.join(xs)}, key from s_{r} where {likely})",
            f"k_{r} as materialized (select * from k_{r - 1} union all "
            f"select (select count(*) from k_{r - 1}) + row_number() over (order by {', '.join(xs)}) - 1, {renamed}, key from drawn_{r})",
        ]
    last = f"k_{START_ROUNDS}"
    ctes += [
        f"s_w as (select cluster, count(*) as w from ({assigned('pts', last, d)}) group by 1)",
        f"cand as materialized (select {last}.*, w from {last} join s_w using (cluster))",
    ]
    gap = " + ".join(f"(cand.{c} - q.{c}) * (cand.{c} - q.{c})" for c in cs)
    for p in range(k):
        race = f"-ln({draw_sql(seed, f'pick {p}')} + {0.5 / 2.0**52!r}) / (w * {'gap' if p else '1'}), cluster"
        found = f"(select *, (select min({gap}) from p_{p - 1} q) as gap from cand)" if p else "cand"
        own = f"select {p}::bigint as pick, {', '.join(cs)} from {found} {'where gap > 0' if p else ''} order by {race} limit 1"
        ctes.append(f"p_{p} as materialized ({f'select * from p_{p - 1} union all ' if p else ''}select * from ({own}))")
    ctes.append(f"c_0 as materialized (select pick as cluster, {', '.join(cs)} from p_{k - 1})")
    return Start(ctes, d)


def lloyd_sql(points: str, centers, rounds: int, tolerance: float | None = None, tail: str | None = None) -> str:
    ctes, d = start_of(points, centers)
    ctes = list(ctes)
    for r in range(rounds):
        means = ", ".join(f"avg(x{j}) as m{j}" for j in range(d))
        moved = ", ".join(f"coalesce(m{j}, c{j}) as c{j}" for j in range(d))
        if tolerance is not None and r:
            gap = " + ".join(f"(a.c{j} - b.c{j}) * (a.c{j} - b.c{j})" for j in range(d))
            stop = f"select max({gap}) <= {tolerance**2!r}::double as stop from c_{r} a join c_{r - 1} b using (cluster)"
            ctes.append(f"stop_{r} as materialized ({stop})")
            moved = ", ".join(
                f"case when (select stop from stop_{r}) then c{j} else coalesce(m{j}, c{j}) end as c{j}" for j in range(d)
            )
        ctes.append(f"a_{r} as materialized ({assigned('pts', f'c_{r}', d)})")
        ctes.append(f"m_{r} as (select cluster, {means} from a_{r} group by cluster)")
        ctes.append(
            f"c_{r + 1} as materialized (select cluster::int as cluster, {moved} from c_{r} left join m_{r} using (cluster))"
        )
    tail = tail or unpivot(f"c_{rounds}", [f"c{j}" for j in range(d)], "cluster::int as cluster", 4)
    return f"with {', '.join(ctes)} {tail}"


OFFSET = "coalesce((1 - gamma) * beta * ell / nullif(gamma * alpha + (1 - gamma) * beta, 0), 0)"


def gamma_steps(r: int) -> list[str]:
    """Tables ``g_r_0`` to ``g_r_9``: the gamma of the ten evaluations on the clusters ``l_r``."""
    ctes = [f"g_{r}_0 as (select 0.5::double as gamma, false as stop)"]
    step = 0.25
    for t in range(1, 10):
        ctes += [
            f"x_{r}_{t} as materialized (select max(fixed_a) + sum(alpha * x * x) as fa, "
            f"max(fixed_b) + sum(beta * (ell - x) * (ell - x)) as fb "
            f"from (select *, {OFFSET} as x from l_{r}, g_{r}_{t - 1}))",
            f"g_{r}_{t} as materialized (select case when stop or fa = fb then gamma when fa > fb "
            f"then gamma + {step!r}::double else gamma - {step!r}::double end as gamma, "
            f"stop or fa = fb as stop from g_{r}_{t - 1}, x_{r}_{t})",
        ]
        step /= 2
    return ctes


def fair_lloyd_sql(points: str, centers, rounds: int, tail: str | None = None) -> str:
    """Fair rounds as chained tables: moments, ten evaluations of gamma, new centres.

    Once the costs of both groups are equal gamma stays, and so do the offsets.
    Labels other than A count with B in the sums, but not in the size of B.
    """
    ctes, d = start_of(points, centers)
    ctes = list(ctes)
    for r in range(rounds):
        raw = ", ".join(
            f"avg(x{j}) filter (g = 'A') as a{j}, avg(x{j}) filter (g <> 'A') as b{j}" for j in range(d)
        )
        spread_a = " + ".join(f"var_pop(x{j}) filter (g = 'A')" for j in range(d))
        spread_b = " + ".join(f"var_pop(x{j}) filter (g <> 'A')" for j in range(d))
        filled = ", ".join(f"coalesce(a{j}, b{j}) as a{j}, coalesce(b{j}, a{j}) as b{j}" for j in range(d))
        gap = " + ".join(f"(a{j} - b{j}) * (a{j} - b{j})" for j in range(d))
        ctes += [
            f"a_{r} as materialized ({assigned('pts', f'c_{r}', d)})",
            f"m_{r} as materialized (select cluster, count(*) filter (g = 'A') as na, "
            f"count(*) filter (g <> 'A') as nb, count(*) filter (g = 'B') as nb_exact, {raw}, "
            f"coalesce(count(*) filter (g = 'A') * ({spread_a}), 0) as sa, "
            f"coalesce(count(*) filter (g <> 'A') * ({spread_b}), 0) as sb from a_{r} group by cluster)",
            f"f_{r} as materialized (select cluster, {filled}, "
            "coalesce(na / nullif(sum(na) over (), 0), 0) as alpha, "
            "coalesce(nb / nullif(sum(nb_exact) over (), 0), 0) as beta, "
            "coalesce(sum(sa) over () / nullif(sum(na) over (), 0), 0) as fixed_a, "
            f"coalesce(sum(sb) over () / nullif(sum(nb_exact) over (), 0), 0) as fixed_b from m_{r})",
            f"l_{r} as materialized (select *, sqrt({gap}) as ell from f_{r})",
        ]
        ctes += gamma_steps(r)
        new = ", ".join(f"case when ell = 0 then a{j} else ((ell - x) * a{j} + x * b{j}) / ell end as n{j}" for j in range(d))
        kept = ", ".join(f"coalesce(n{j}, c{j}) as c{j}" for j in range(d))
        ctes += [
            f"n_{r} as (select cluster, {new} from (select *, {OFFSET} as x from l_{r}, g_{r}_9))",
            f"c_{r + 1} as materialized (select cluster::int as cluster, {kept} from c_{r} left join n_{r} using (cluster))",
        ]
    tail = tail or unpivot(f"c_{rounds}", [f"c{j}" for j in range(d)], "cluster::int as cluster", 4)
    return f"with {', '.join(ctes)} {tail}"


for _rounds in (1, 3):
    add(f"lloyd_{_rounds}", lloyd_sql(LI, fx.CENTERS_LI, _rounds))
    add(f"fair_lloyd_{_rounds}", fair_lloyd_sql(LI, fx.CENTERS_LI, _rounds))
    add(f"fair_lloyd_three_{_rounds}", fair_lloyd_sql(THREE, fx.CENTERS_THREE, _rounds))


START = kmeans_start(LI, 3, 3, q.SEED)
add("kmeans_init", lloyd_sql(LI, START, 0))
add("kmeans_standard", lloyd_sql(LI, START, 10, TOLERANCE))
add("fair_lloyd_auto", fair_lloyd_sql(LI, START, 5))
PHI = f"select greatest(delta_a, delta_b) as phi from (select {DELTAS} from ({assigned('pts', 'c_5', 3)}))"
TIMED = ", ".join(f"true as t_{name}" for name in ("std_centers", "fair_centers", "std_obj", "fair_obj"))
add(
    "compare_fairness",
    f"select round(s.phi, 4) as phi_std, round(f.phi, 4) as phi_fair, {TIMED} "
    f"from ({lloyd_sql(LI, START, 5, TOLERANCE, PHI)}) s, ({fair_lloyd_sql(LI, START, 5, PHI)}) f",
)
add(
    "fair_objectives",
    " union all ".join(
        f"select {i} as set, * from ({with_assigned(LI, centers, FAIR)})"
        for i, centers in enumerate([fx.CENTERS_LI, fx.CENTERS_LI[:2], fx.CENTERS_LI[::-1]])
    ),
)


def fair_lloyd_long_sql(rounds: int) -> str:
    """Fair rounds on the embeddings, with one row per coordinate."""
    ctes = [
        "e as materialized (select vec_id, label, " + fx.EMB_GROUP + " as g, unnest(embedding)::double as v, "
        "generate_subscripts(embedding, 1) - 1 as j from embeddings)",
        "c_0 as materialized (select label as cluster, j, avg(v) as m from e group by all)",
    ]
    for r in range(rounds):
        ctes += [
            f"d_{r} as (select vec_id, cluster, sum((v - m) * (v - m)) as d from e join c_{r} using (j) group by all)",
            f"a_{r} as materialized (select vec_id, arg_min(cluster, d) as cluster from d_{r} group by vec_id)",
            f"m_{r} as materialized (select cluster, j, count(*) filter (g = 'A') as na, count(*) filter (g = 'B') as nb, "
            "avg(v) filter (g = 'A') as a, avg(v) filter (g = 'B') as b, "
            "var_pop(v) filter (g = 'A') as va, var_pop(v) filter (g = 'B') as vb "
            f"from e join a_{r} using (vec_id) group by all)",
            f"f_{r} as materialized (select cluster, max(na) as na, max(nb) as nb, "
            "sqrt(sum((coalesce(a, b) - coalesce(b, a)) * (coalesce(a, b) - coalesce(b, a)))) as ell, "
            f"coalesce(sum(na * va), 0) as sa, coalesce(sum(nb * vb), 0) as sb from m_{r} group by cluster)",
            f"l_{r} as materialized (select cluster, ell, na / sum(na) over () as alpha, nb / sum(nb) over () as beta, "
            f"sum(sa) over () / sum(na) over () as fixed_a, sum(sb) over () / sum(nb) over () as fixed_b from f_{r})",
            *gamma_steps(r),
            f"c_{r + 1} as materialized (select c_{r}.cluster, c_{r}.j, coalesce(case when ell = 0 then coalesce(a, b) "
            f"else ((ell - x) * coalesce(a, b) + x * coalesce(b, a)) / ell end, c_{r}.m) as m "
            f"from c_{r} left join m_{r} using (cluster, j) "
            f"left join (select cluster, ell, {OFFSET} as x from l_{r}, g_{r}_9) using (cluster))",
        ]
    return f"with {', '.join(ctes)} select cluster::int as cluster, j::int as dim, round(m, 4) as v from c_{rounds}"


add("fair_lloyd_emb", fair_lloyd_long_sql(3))
add("fair_lloyd_emb_bounded", fair_lloyd_long_sql(3))
add("lloyd_bounded", lloyd_sql(LI, fx.CENTERS_LI, 3))


# Items: parsing, hashing, sketches


def residue(a: int | str, b: int | str, prime: int) -> str:
    return f"(({a} * (item % {prime}) + {b}) % {prime})"


def hash_values(rows) -> str:
    values = ", ".join(f"({d}, {', '.join(map(str, row))})" for d, row in enumerate(rows))
    return f"select * from (values {values}) h(d, cm_a, cm_b, cs_a, cs_b, sg_a, sg_b)"


SIGN = f"case when {residue('sg_a', 'sg_b', fx.PRIME)} % 2 = 0 then 1 else -1 end"


def sketch_ctes(items: str, rows, w: int, prime: int) -> str:
    """``h`` hashes, ``hist``, ``p`` probes per item and row, ``cm`` and ``cs`` cells."""
    sign = f"case when {residue('sg_a', 'sg_b', prime)} % 2 = 0 then 1 else -1 end"
    return f"""with items as ({items}), h as ({hash_values(rows)}),
    hist as materialized (select item, count(*) as freq from items group by item),
    p as materialized (
        select item, freq, d, ({residue('cm_a', 'cm_b', prime)} % {w})::int as cm_col,
               ({residue('cs_a', 'cs_b', prime)} % {w})::int as cs_col, {sign} as sign
        from hist, h),
    cm as materialized (select d, cm_col as col, sum(freq)::bigint as v from p group by all),
    cs as materialized (select d, cs_col as col, sum(sign * freq)::bigint as v from p group by all),
    est_cm as (select item, min(v) as est from p join cm on p.d = cm.d and cm_col = col group by item),
    est_cs as (
        select item, case when n % 2 = 1 then l[n // 2 + 1] else (l[n // 2] + l[n // 2 + 1]) // 2 end as est
        from (select item, count(*) as n, list(sign * v order by sign * v) as l
              from p join cs on p.d = cs.d and cs_col = col group by item)),
    top as materialized (
        select item, freq from hist
        where freq >= (select case when count(*) = {q.TOP_K} then min(freq) end
                       from (select freq from hist order by freq desc limit {q.TOP_K}))),
    shown as materialized (
        select top.item, freq, case when freq >= 2 then est_cm.est end as est_cm,
               case when freq >= 2 then est_cs.est end as est_cs
        from top left join est_cm using (item) left join est_cs using (item)),
    errors as (
        select count(*) as n_top, avg(abs(freq - coalesce(est_cm, 0)) / freq) as err_cm,
               avg(abs(freq - coalesce(est_cs, 0)) / freq) as err_cs from shown)
    """


add(
    "items_permissive",
    f"""select item % 5 <> 0 as accepted, item || case when item % 5 = 0 then 'x' else '' end as value
    from ({fx.sql_items('part')})""",
)
add("parse_items", f"select item from ({fx.sql_items('part')})")
add(
    "hash_bucket",
    "select item, "
    + ", ".join(
        f"({residue(h.cm_a, h.cm_b, fx.PRIME)} % {q.W_PART})::int as b{d}" for d, h in enumerate(fx.HASHES)
    )
    + f" from ({fx.sql_items('order')})",
)
add(
    "hash_sign",
    "select item, "
    + ", ".join(
        f"case when {residue(h.sg_a, h.sg_b, fx.PRIME)} % 2 = 0 then 1 else -1 end as s{d}"
        for d, h in enumerate(fx.HASHES)
    )
    + f" from ({fx.sql_items('order')})",
)
def wide_residue(a: int | str, b: int | str) -> str:
    item = f"(((item::hugeint % {WIDE_PRIME}) + {WIDE_PRIME}) % {WIDE_PRIME})"
    # The product has up to 122 bits; a hugeint has 127.
    return f"((({a})::hugeint * {item} + {b}) % {WIDE_PRIME})"


WIDE_ITEMS = fx.sql_items("wide")
add(
    "hash_wide",
    "select item, "
    + ", ".join(
        f"({wide_residue(h.cm_a, h.cm_b)} % {q.W_PART})::int as b{d}, "
        f"case when {wide_residue(h.sg_a, h.sg_b)} % 2 = 0 then 1 else -1 end as s{d}"
        for d, h in enumerate(fx.WIDE_HASHES)
    )
    + f" from ({WIDE_ITEMS})",
)
add(
    "cs_cells_wide",
    f"with h as ({hash_values(fx.WIDE_HASHES)}) select d::int as d, ({wide_residue('cs_a', 'cs_b')} % {q.W_PART})::int as col, "
    f"sum(case when {wide_residue('sg_a', 'sg_b')} % 2 = 0 then 1 else -1 end)::bigint as v "
    f"from ({WIDE_ITEMS}), h group by 1, 2",
)
CM_CELLS = "select d::int as d, col, v from cm"
CS_CELLS = "select d::int as d, col, v from cs"
add(
    "hash_family",
    sketch_ctes(fx.sql_items("order"), draw_rows(3, DEFAULT_PRIME, q.SEED), q.W_PART, DEFAULT_PRIME) + CM_CELLS,
)
BOTH_ITEMS = f"({fx.sql_items('part')}) union all ({fx.sql_items('user')})"
SKEW_3 = sketch_ctes(fx.sql_items("skew"), fx.HASHES[:3], q.W_SKEW, fx.PRIME)
SKEW_4 = sketch_ctes(fx.sql_items("skew"), fx.HASHES, q.W_SKEW, fx.PRIME)
PART_3 = sketch_ctes(fx.sql_items("part"), fx.HASHES[:3], q.W_PART, fx.PRIME)
PART_4 = sketch_ctes(fx.sql_items("part"), fx.HASHES, q.W_PART, fx.PRIME)
ONCE_4 = sketch_ctes(fx.sql_items("once"), fx.HASHES, q.W_PART, fx.PRIME)
ORDER_4 = sketch_ctes(fx.sql_items("order"), fx.HASHES, q.W_ORDER, DEFAULT_PRIME)
MERGED_4 = sketch_ctes(BOTH_ITEMS, fx.HASHES, q.W_PART, fx.PRIME)
HIST = "select item, freq from hist"
add("item_hist", SKEW_3 + HIST)
add("item_hist_merged", MERGED_4 + HIST)
SUMMARY = "select sum(freq)::bigint as n_items, count(*) as n_distinct from hist"
add("stream_summary", PART_3 + SUMMARY)
add(
    "distinct_merged",
    "select 'users' as name, count(distinct user_id) as n, true as close from events "
    "union all select 'orders', count(distinct l_orderkey), true from lineitem",
)
add("top_k_merged", SKEW_3 + HIST)
add("cms_cells", SKEW_3 + CM_CELLS)
add("cs_cells", SKEW_3 + CS_CELLS)
add("cms_merge", MERGED_4 + CM_CELLS)
add("cs_merge", MERGED_4 + CS_CELLS)
EST_CM, EST_CS = "select item, est::bigint as est from est_cm", "select item, est::bigint as est from est_cs"
add("cms_estimate", PART_3 + EST_CM)
add("cs_estimate", PART_3 + EST_CS)
add("cs_estimate_even", PART_4 + EST_CS)
add("cms_estimate_order", ORDER_4 + EST_CM)
add(
    "stored_estimates",
    ORDER_4 + "select item, freq, est_cm.est::bigint as est_cm, est_cs.est::bigint as est_cs "
    "from hist join est_cm using (item) join est_cs using (item)",
)
add("cs_estimate_skew", SKEW_4 + EST_CS)

# Heavy hitters


def phi_sql(k: int) -> str:
    return (
        f"select case when count(*) = {k} then min(freq) end as phi "
        f"from (select freq from hist order by freq desc limit {k})"
    )


add("phi_k", PART_3 + phi_sql(q.TOP_K))
add("phi_k_large", ORDER_4 + phi_sql(q.LARGE_K))
add("heavy_hitters", PART_3 + "select item, freq from top")
add("heavy_hitters_once", ONCE_4 + "select item, freq from top")
add(
    "frequent_item_estimates",
    PART_4
    + "select item, freq, est_cm.est::bigint as est_cm, est_cs.est::bigint as est_cs "
    + "from hist join est_cm using (item) join est_cs using (item) where freq >= 2",
)
ERRORS = "round(err_cm, 6) as err_cm, round(err_cs, 6) as err_cs"
add("topk_error", PART_4 + f"select n_top, {ERRORS} from errors where n_top > 0")
add("topk_error_once", ONCE_4 + f"select n_top, {ERRORS} from errors where n_top > 0")
LISTING = f"select item, freq, coalesce(est_cm, 0)::bigint as est_cm from shown order by item limit {q.TOP_K}"
add("heavy_hitter_listing", PART_4 + LISTING)
add("heavy_hitter_report_listing", PART_4 + LISTING)
REPORT = f"select n_items, n_distinct, n_top, {ERRORS} from ({SUMMARY}), errors"
add("heavy_hitter_report", PART_4 + REPORT)
add("heavy_hitter_report_skew", SKEW_4 + REPORT)

# Streams

PREFIX = f"""with days as (select ts::date as batch, count(*)::bigint as n from events group by 1),
    running as (select batch, n, coalesce(sum(n) over (
        order by batch rows between unbounded preceding and 1 preceding), 0)::bigint as prior from days),
    kept as (select * from running where prior < {q.PREFIX_T})
    """
add("prefix_until_t", PREFIX + "select batch::varchar as batch, n, prior from kept")
add("stream_hist", SKEW_3 + HIST)
add("stream_cms", PART_4 + CM_CELLS)
add("stream_cs", PART_4 + CS_CELLS)
ALL_TABLES = f"""select 0 as kind, item as key, freq::bigint as v from hist
    union all select 1, d * {q.W_SKEW} + col, v::bigint from cm
    union all select 2, d * {q.W_SKEW} + col, v::bigint from cs"""
add("frequency_tables", SKEW_3 + ALL_TABLES)
add("stream_tables", SKEW_3 + ALL_TABLES)
add("batch_table", ORDER_4 + HIST)
# The table is one file, hence one micro-batch, which is taken whole.
PREFIX_SKETCH = sketch_ctes(fx.sql_items("user"), fx.HASHES, q.W_SKEW, fx.PRIME)
add("stream_prefix", PREFIX_SKETCH + HIST)
add("stream_prefix_report", PREFIX_SKETCH + REPORT)
