"""Small inputs that queries and their SQL share: run logs and transfer times."""


def _log(**phases: list[int]) -> str:
    return "\n".join(line for name, us in phases.items() for line in (f'Phase "{name}":', *(f"   node {i:2d}: {u} microsecs :: {u / 1e3 + 0.5:.0f} millisecs :: {u / 1e6 + 0.5:.0f} secs" for i, u in enumerate(us))))


LOGS = {
    "result_n1_M1024_sequential_s1_t1": _log(sorting=[900], spd=[1001]),
    "result_n1_M1024_sequential_s1_t2": _log(sorting=[920], spd=[1004]),
    "result_n2_M1024_samplesort_s1_t1": _log(sorting=[400, 420], spd=[600, 580]),
    "result_n2_M1024_samplesort_s2_t1": _log(sorting=[410, 430], spd=[611, 590]),
    "result_n4_M1024_samplesort_s1_t1": _log(sorting=[210, 190, 260, 200], spd=[380, 370, 390, 375]),
    "result_n4_M2048_samplesort_s1_t1": _log(sorting=[420, 390, 500, 410], spd=[760, 740, 790, 750]),
}
TRANSFERS = [(1 << i, 60.0 + 0.101 * (1 << i) + (i % 3)) for i in range(2, 18)]
