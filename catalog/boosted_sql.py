"""Histogram boosting written out as SQL, one step after the other, to hold the trees of the library against."""

from __future__ import annotations

from collections.abc import Sequence


def boosted_ctes(prefix: str, rows: str, features: Sequence[str], trees: int, depth: int, rate: float, bins: int, train: str = "true") -> str:
    """CTEs over the relation ``rows`` (event_id, target, weight, a column per feature); ``train`` marks its training rows.

    Leaves ``{prefix}nodes`` (tree, node, feature, threshold, missing_left, gain, value) and ``{prefix}scores``
    (event_id, margin) of all rows. The l2 penalty and the least Hessian of a child are 1.
    """
    p = prefix
    names = ", ".join(f"('{f}', {i})" for i, f in enumerate(features))
    wide = ", ".join(f"coalesce(cast({f} as double), 'nan'::double) as {f}" for f in features)
    ctes = [
        f"{p}place(name, feature) as (values {names})",
        f"""{p}long as materialized (select event_id, feature, case when isnan(x) then null else x end as x, trains from
            (unpivot (select event_id, {train} as trains, {wide} from {rows}) on columns(* exclude (event_id, trains)) into name name value x)
            join {p}place using (name))""",
        f"{p}range as (select feature, min(x) as lo, max(x) as hi from {p}long where trains group by feature)",
        f"""{p}edge as materialized (select feature, cut, row_number() over (partition by feature order by cut) as k from
            (select distinct feature, lo + (hi - lo) * j / {bins} as cut from {p}range, range(1, {bins}) r(j)))""",
        f"""{p}bin as materialized (select event_id, l.feature, trains,
            case when max(x) is null then 0 else 1 + count(*) filter (where cut < x) end as bin
            from {p}long l left join {p}edge e on e.feature = l.feature group by event_id, l.feature, trains)""",
        f"{p}m0 as (select event_id, target, weight, {train} as trains, cast(0 as double) as margin from {rows})",
    ]
    splits = []
    for t in range(trees):
        ctes += [
            f"""{p}g{t} as materialized (select event_id, round_even((q - target) * weight * 1048576, 0) / 1048576 as g,
                round_even(q * (1 - q) * weight * 1048576, 0) / 1048576 as h
                from (select *, 1 / (1 + exp(-margin)) as q from {p}m{t} where trains))""",
            f"{p}n{t}_0 as (select event_id, 0 as node from {p}m{t})",
        ]
        for d in range(depth):
            low, high = 2**d - 1, 2 ** (d + 1) - 2
            ctes += [
                f"""{p}s{t}_{d} as materialized (select node, feature, bin, sum(g) as g, sum(h) as h from {p}bin
                    join {p}n{t}_{d} using (event_id) join {p}g{t} using (event_id) where node between {low} and {high} group by all)""",
                f"{p}t{t}_{d} as (select node, sum(g) as g, sum(h) as h from {p}s{t}_{d} where feature = 0 group by node)",
                f"""{p}c{t}_{d} as (select t.node, e.feature, e.k, e.cut, side, t.g as tg, t.h as th,
                    coalesce(sum(s.g) filter (where s.bin between 1 and e.k or s.bin = 0 and side = 0), 0) as lg,
                    coalesce(sum(s.h) filter (where s.bin between 1 and e.k or s.bin = 0 and side = 0), 0) as lh
                    from {p}t{t}_{d} t cross join {p}edge e cross join range(2) r(side)
                    left join {p}s{t}_{d} s on s.node = t.node and s.feature = e.feature
                    group by t.node, e.feature, e.k, e.cut, side, t.g, t.h)""",
                f"""{p}b{t}_{d} as materialized (select node, feature, k, cut, side, gain from
                    (select *, lg * lg / (lh + 1) + (tg - lg) * (tg - lg) / (th - lh + 1) - tg * tg / (th + 1) as gain from {p}c{t}_{d}
                    where lh >= 1 and th - lh >= 1) where gain > 1e-9
                    qualify row_number() over (partition by node order by gain desc, feature, k, side) = 1)""",
                f"""{p}n{t}_{d + 1} as materialized (select n.event_id, case when b.node is null then n.node
                    when (x.bin = 0 and b.side = 0) or x.bin between 1 and b.k then 2 * n.node + 1 else 2 * n.node + 2 end as node
                    from {p}n{t}_{d} n left join {p}b{t}_{d} b on b.node = n.node
                    left join {p}bin x on x.event_id = n.event_id and x.feature = b.feature)""",
            ]
            splits.append(
                f"""select {t} as tree, node, name as feature, cut as threshold, side = 0 as missing_left, gain, cast(null as double) as value
                from {p}b{t}_{d} join {p}place using (feature)"""
            )
        ctes += [
            f"""{p}v{t} as materialized (select node, -{rate} * sum(g) / (sum(h) + 1) as value
                from {p}n{t}_{depth} join {p}g{t} using (event_id) group by node)""",
            f"""{p}m{t + 1} as materialized (select event_id, target, weight, trains, margin + coalesce(value, 0) as margin
                from {p}m{t} join {p}n{t}_{depth} using (event_id) left join {p}v{t} using (node))""",
        ]
        splits.append(f"select {t}, node, null, null, null, null, value from {p}v{t}")
    ctes += [f"{p}nodes as ({' union all '.join(splits)})", f"{p}scores as (select event_id, margin, trains, target from {p}m{trees})"]
    return ",\n".join(ctes)
