"""The same queries as SQL on the same tables."""

from __future__ import annotations

from ordovar.functions.intmath import ceil_log2
from ordovar.operators.strategies import ALGORITHMS, bitonic_rounds
from ordovar.plans.fixtures import LOGS, TRANSFERS

N = 8
P = "P as (select ntile(8) over (order by event_id) - 1 as part, row_number() over (order by event_id) - 1 as pos, user_id as value from events)"
L = "L as (select *, row_number() over (partition by part order by value, pos) - 1 as i, count(*) over (partition by part) as c from P)"
S = "S as (select part, i // (c // 8) as k, value as splitter from L where i > 0 and i % (c // 8) = 0 and i // (c // 8) <= 7)"
G = "G as (select r // 7 - 1 as idx, splitter from (select splitter, row_number() over (order by splitter) - 1 as r from S) where r > 0 and r % 7 = 0 and r // 7 <= 7)"
B = "B as (select P.*, (select count(*) from G where splitter < value) as bucket from P)"
H = "H as (select part, bucket, count(*) as cnt from B group by 1, 2)"
RANKED = "select part, row_number() over (partition by part order by value, pos) - 1 as i, value from"

ORACLE: dict[str, str] = {f"sort_{a}": f"with {P} select row_number() over (order by value) - 1 as pos, value from P" for a in ALGORITHMS}
ORACLE |= {
    "scatter_counts": f"with {P} select part, count(*) as cnt, min(pos) as displ from P group by part",
    "scatterv_slices": f"with {P}, C as (select count(*) as m from P), V(part, cnt, displ) as (select 0::bigint, m // 4, 0 from C union all select 1, 0, m // 4 from C union all select 2, m // 2, m // 4 from C union all select 3, m - m // 4 - m // 2, m // 4 + m // 2 from C) select V.part, pos - displ as local_pos, value from P join V on pos >= displ and pos < displ + cnt",
    "gatherv_positions": f"with {P} select row_number() over (order by value % 8, pos) - 1 as pos, value from P",
    "local_sort": f"with {P}, {L} select part, i, value from L",
    "local_splitters": f"with {P}, {L}, {S} select part, k, splitter from S",
    "global_splitters": f"with {P}, {L}, {S}, {G} select idx, splitter from G",
    "bucket_histogram": f"with {P}, {L}, {S}, {G}, {B}, {H} select part, bucket, cnt from H",
    "count_transpose": f"with {P}, {L}, {S}, {G}, {B}, {H} select bucket as part, " + ", ".join(f"coalesce(sum(cnt) filter (part = {i}), 0)::bigint as from_{i}" for i in range(N)) + " from H group by bucket",
    "send_displacements": f"with {P}, {L}, {S}, {G}, {B}, {H} select part, bucket, cnt, coalesce(sum(cnt) over (partition by part order by bucket rows between unbounded preceding and 1 preceding), 0)::bigint as sdispl, coalesce(sum(cnt) over (partition by bucket order by part rows between unbounded preceding and 1 preceding), 0)::bigint as rdispl from H",
    "fixed_range_histogram": "select least((o_orderkey * 143151 % 2147483648) // 268435456, 7) as bucket, count(*) as cnt from orders group by 1",
    "alltoall_transpose": f"with {P}, T as (select *, row_number() over (partition by part order by pos) - 1 as l, (((select count(*) from P) + 7) // 8 + 7) // 8 as b from P) select l // b as part, part * b + l % b as local_pos, value from T",
    "alltoallv_exchange": f"with {P}, {L}, {S}, {G}, {B} select bucket as part, row_number() over (partition by bucket order by part, value, pos) - 1 as local_pos, value from B",
    "sendrecv_pairs": f"with {P} select xor(part, 1) as part, count(*) as cnt, sum(value)::bigint as total from P group by 1",
    "kway_merge": "select c_mktsegment as \"group\", row_number() over (partition by c_mktsegment order by c_acctbal, c_nationkey) - 1 as i, c_acctbal as value from customer",
    "double_keys_sorted": "select row_number() over (order by c_acctbal, c_custkey) - 1 as pos, c_acctbal, c_custkey from customer",
    "timestamp_keys_sorted": "select row_number() over (order by o_orderdate, o_orderkey) - 1 as pos, epoch(o_orderdate)::bigint as day, o_orderkey from orders",
    "is_sorted_check": f"with {P}, T as (select 'dealt' as what, pos, value from P union all select 'sorted', row_number() over (order by value) - 1, value from P), U as (select what, value, lag(value) over (partition by what order by pos) as before from T) select what, count(*) filter (before > value) as inversions, count(*) filter (before > value) = 0 as is_sorted from U group by what",
    "sendrecv_slices": f"with {P}, T as (select part, row_number() over (partition by part order by pos) - 1 as l, count(*) over (partition by part) as c, value from P), Z as (select distinct part, c from T) select part, l as local_pos, value from T where l < c // 2 union all select xor(T.part, 1), Z.c // 2 + l - T.c // 4, value from T join Z on Z.part = xor(T.part, 1) where l >= T.c // 4 and l < T.c // 4 + T.c // 2",
    "gather_equal": f"with {P}, T as (select part, row_number() over (partition by part order by value, pos) - 1 as l, value from P) select part * (((select count(*) from P) + 7) // 8) + l as pos, value from T",
    "bcast_rows": "select r_regionkey::bigint as value, part from region, range(8) t(part)",
    "receive_appended": f"with {P}, T as (select part, row_number() over (partition by part order by pos) - 1 as l, value from P), Z as (select part, count(*) as c from T group by part) select part, l as local_pos, value from T union all select Z.part, Z.c + l, value from T join Z on Z.part = xor(T.part, 1)",
    "phase_gather": "select phase, node, us, floor(us / 1e3 + 0.5)::bigint as ms, floor(us / 1e6 + 0.5)::bigint as s from (select 'sorting' as phase, i as node, 1000 * i + 499 as us from range(3) t(i) union all select 'spd', i, 1500000 * i from range(3) t(i))",
    "first_inversion": f"with {P}, T as (select pos, lag(value) over (order by pos) as before, value from P) select pos, before, value from T where before > value order by pos limit 1",
    "multiset_checksum": "select count(*) as n, sum(user_id)::bigint as total, bit_xor(user_id) as mixed from events",
    "items_text": f"with {P}, T as (select *, row_number() over (partition by part order by pos) as r from P) select part, '{{' || string_agg(value::varchar, ',' order by r) filter (r <= 10) || case when max(r) > 10 then ',...}}' else '}}' end as items from T group by part",
}
for _side, _kept in (("low", "i <= sa"), ("high", "i > sb")):
    ORACLE[f"compare_split_{_side}"] = f"""
with t as (select n_regionkey as pair, n_nationkey::bigint as value, row_number() over (partition by n_regionkey order by n_nationkey) as i,
  count(*) filter (n_nationkey % 2 = 0) over (partition by n_regionkey) as sa, count(*) filter (n_nationkey % 2 = 1) over (partition by n_regionkey) as sb from nation)
select pair::bigint as pair, row_number() over (partition by pair order by i) - 1 as i, value from t where {_kept}"""
for _t in range(1, 4):
    ORACLE[f"mergesort_round_{_t}_map_0"] = f"with {P}, R as (select part % {N >> _t} as part, pos, value from P) {RANKED} R"
    ORACLE[f"mergesort_round_{_t}_map_1"] = f"with {P}, R as (select part - part % {1 << _t} as part, pos, value from P) {RANKED} R"
    ORACLE[f"lbmerge_round_{_t}"] = f"with {P}, {L}, {S}, {G}, R as (select part - part % {1 << _t} + (select count(*) from G where idx between part - part % {1 << _t} and part - part % {1 << _t} + {(1 << _t) - 2} and splitter < value) as part, pos, value from P) {RANKED} R"
    _chain = ["Q0 as (select 0 as node, pos, value from P)", "S0 as (select 0 as node, value from P where value is not null and ((pos % 2147483648) * 2654435761 + 1) % 4294967296 < least(4294967296, 17592186044416 // (select count(*) from P) + 1))"]
    for _l in range(_t):
        _chain.append(f"V{_l} as (select node, value as cut from (select node, value, row_number() over (partition by node order by value) as r, count(*) over (partition by node) as c from S{_l}) where r = (c + 1) // 2)")
        _chain += [f"{_x}{_l + 1} as (select 2 * {_x}{_l}.node + coalesce(value > cut, false)::int as node, {_c}value from {_x}{_l} left join V{_l} using (node))" for _x, _c in (("Q", "pos, "), ("S", ""))]
    ORACLE[f"quicksort_level_{_t}"] = f"with {P}, " + ", ".join(_chain) + f" select node::bigint as node, pos, value from Q{_t}"
for _t, _active in ((1, 2), (2, 1)):
    ORACLE[f"kmerge_round_{_t}"] = f"with {P}, R as (select part % {_active} as part, pos, value from P) {RANKED} R"
_steps = [P, "R0 as (select * from P)"]
for _t, (_mask, _bit) in enumerate(bitonic_rounds(N), 1):
    _steps.append(
        f"R{_t} as (select case when (r <= c // 2) = (lo & {1 << _bit} = 0) then lo else lo + {_mask} end as part, pos, value from (select *, row_number() over (partition by lo order by value, pos) as r, count(*) over (partition by lo) as c from (select *, part - (part & {_mask}) as lo from R{_t - 1})))"
    )
    ORACLE[f"bitonic_round_{_t}"] = f"with {', '.join(_steps)} {RANKED} R{_t}"

_LINES = ", ".join("('{}', {}, '{}')".format(f, i, x) for f, text in LOGS.items() for i, x in enumerate(text.split("\n")))
_RUNS = f"""lines(file, line_no, line) as (values {_LINES}),
marked as (select *, last_value(case when line like 'Phase%' then regexp_extract(line, 'Phase "([^"]*)"', 1) end ignore nulls) over (partition by file order by line_no) as phase from lines),
runs as (select regexp_extract(file, '_([a-z0-9]+)_s', 1) as algo, regexp_extract(file, '_n(\\d+)', 1)::int as n, regexp_extract(file, '_M(\\d+)', 1)::bigint as m, regexp_extract(file, '_s(\\d+)_t', 1)::int as seed,
  regexp_extract(file, '_t(\\d+)$', 1)::int as trial, phase, regexp_extract(line, 'node +(\\d+):', 1)::int as node, regexp_extract(line, '(\\d+) microsecs', 1)::bigint as us from marked where line like '%microsecs%'),
every as (select * from runs where algo <> 'sequential' union all select algo, x.n, m, seed, trial, phase, node, us from runs, (select distinct n from runs) x where algo = 'sequential'),
avgs as (select algo, m, n, (sum(us) // count(*))::bigint as us from every where phase = 'spd' and node = 0 group by all)"""
ORACLE |= {
    "phase_log_parse": f"with {_RUNS} select * from runs",
    "phase_avg_by_n": f"with {_RUNS} select * from avgs",
    "phase_pivot_nxta": f"with {_RUNS} select n, max(us) filter (algo = 'samplesort') as samplesort, max(us) filter (algo = 'sequential') as sequential from avgs group by n",
    "phase_pivot_mxtn": f"with {_RUNS} select m, max(us) filter (n = 2) as n_2, max(us) filter (n = 4) as n_4 from avgs where algo = 'samplesort' group by m",
    "phase_pivot_nxtm": f"with {_RUNS} select n, max(us) filter (m = 1024) as m_1024, max(us) filter (m = 2048) as m_2048 from avgs where algo = 'samplesort' group by n",
    "phase_pivot_mxta": f"with {_RUNS} select m, max(us) filter (algo = 'samplesort') as samplesort, max(us) filter (algo = 'sequential') as sequential from avgs where n = 4 group by m",
    "phase_select": f"with {_RUNS} select * from runs where phase = 'sorting'",
    "chunk_grid": "select (1::bigint << e)::bigint as calls, (8388608 >> e)::bigint as block, ((8388608 >> e) // 8)::bigint as share from range(14) t(e)",
    "token_owners": "select m as mapping, i, case when m = 0 then i else (i & 1) * 8 + ((i >> 1) & 1) * 4 + ((i >> 2) & 1) * 2 + ((i >> 3) & 1) end as owner from range(2) t(m), range(16) u(i)",
    "phase_skew": f"with {_RUNS}, a as (select algo, n, phase, node, avg(us) as us from runs group by all) select *, max(us) over w / avg(us) over w as skew from a window w as (partition by algo, n, phase)",
    "campaign_grid": "select t::int as trial, (1::bigint << e)::bigint as m, n::int as n, s::int as seed, a as algo from range(1, 4) x(t), range(20, 31) y(e), (values (1), (2), (4), (8), (16)) z(n), range(1, 4) u(s), (values ('sequential'), "
    + ", ".join(f"('{a}')" for a in ALGORITHMS if not a.startswith("sequential"))
    + ") v(a) where (n = 1) = (a = 'sequential')",
    "bytes_human": "select size, case when size >= 1073741824 then (size // 1073741824) || ' GB' when size >= 1048576 then (size // 1048576) || ' MB' when size >= 1024 then (size // 1024) || ' KB' else size || ' B' end as human from (select (1::bigint << i)::bigint as size from range(40) r(i))",
    "math_helpers": "select n, ceil(log2(n))::bigint as log2, ceil(log2(n))::bigint // 2 as log4, (n & (n - 1)) = 0 as power from range(1, 130) r(n)",
    "tsend_fit": "select round(regr_intercept(t, l), 6) as setup_us, round(regr_slope(t, l), 9) as us_per_byte from (values " + ", ".join(f"({n}, {t!r}::double)" for n, t in TRANSFERS) + ") v(l, t)",
    "algorithm_efficiency": "with g as (select n, k, floor(round(ln(n) / ln(k), 9) + 1)::int as m from (values (2), (4), (8), (16), (32), (64), (128)) a(n), (values (2), (4), (8)) b(k)) select case when k = 2 then 'mergesort' else 'kmerge' end as algo, n, k, (select sum(n / pow(k, i)) from range(m) r(i)) / (n * m) as phi from g union all select 'quicksort', n, k, (select sum(n / pow(k, i)) from range(m) r(i)) / (n * m) from g where k = 2 union all select a, n, 0, 1.0::double from (values ('bitonicsort'), ('bucketsort'), ('lbkmergesort'), ('lbmergesort'), ('samplesort')) x(a), (values (2), (4), (8), (16), (32), (64), (128)) y(n)",
}


def _talks(pairs: str) -> str:
    return f"with t as ({pairs}) select step, s as part, 'send' as role, r as peer from t union all select step, r, 'receive', s from t"


_STEPS = f"range({ceil_log2(16)}) x(step), range(16) y(p)"
ORACLE |= {
    "stencil_mergesort_0": _talks(f"select step, p + (16 >> (step + 1)::int) as s, p as r from {_STEPS} where p < 16 >> (step + 1)::int"),
    "stencil_mergesort_1": _talks(f"select step, p + (1 << step::int) as s, p as r from {_STEPS} where p % (2 << step::int) = 0"),
    "stencil_quicksort_0": _talks(f"select step, p as s, p + (16 >> (step + 1)::int) as r from {_STEPS} where p % (16 >> step::int) = 0"),
    "stencil_quicksort_1": _talks(f"select step, p as s, p + (1 << step::int) as r from {_STEPS} where p < 1 << step::int"),
    "stencil_kmerge_0": _talks("select step, p as s, p % (16 // pow(4, step + 1)::bigint) as r from range(2) x(step), range(16) y(p) where p >= 16 // pow(4, step + 1)::bigint and p < 16 // pow(4, step)::bigint"),
    "stencil_bitonicsort_0": "with ij as (select row_number() over (order by i, j) - 1 as step, i - 1 - j as b from range(1, 5) x(i), range(4) y(j) where j < i) select step, p as part, 'exchange' as role, xor(p, (1 << b::int)::bigint) as peer from ij, range(16) y(p)",
    "stencil_lbmergesort_0": "with g as (select e, (1 << e::int)::bigint as g from range(4) t(e)), x as (select g - 1 + o as step, p, g, o from g, range(8) u(o), range(16) v(p) where o < g) select step, p as part, 'exchange' as role, xor(p - p % g, g) + (case when p & g = 0 then p + o else p - o + 16 end) % g as peer from x",
}
