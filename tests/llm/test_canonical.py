"""p4: forms, rules, edits, ties and the defined results."""

import random

import pytest

from ohmgrid.llm import canonical

FILES = "id int, device_id string, data_source string, part_number string"
LIBRARY = [("TSX650F040-1D", "Tessarac Devices"), ("TSX650F080-1D", "Tessarac Devices"), ("QLD1-650-S150A", "Quillon Power"), ("NH120R080T2B", None)]
RULES = [(1, "ONYX", "substring", "all", 100, "P1"), (2, "ONYX-20", "substring", "all", 100, "P2"), (3, "onyx-20", "substring", "sc", 120, "P3"), (4, r"^LOT4[ _-]?[A-F]\d{2}", "regex", "all", 120, "P4"), (5, None, "regex", "all", 900, "P5")]


def answers(spark, typed, library=LIBRARY, rules=RULES):
    files = spark.createDataFrame([(i, d, s, "clash") for i, (d, s) in enumerate(typed)], FILES)
    lib = spark.createDataFrame([(i, p, m, "clash") for i, (p, m) in enumerate(library)], "id int, part_number string, manufacturer string, device_id string")
    r = spark.createDataFrame(rules, "id int, pattern string, pattern_type string, scope string, priority int, part_number string")
    got = {x.metadata_id: x.part_number for x in canonical.canonical_parts(files, lib, r).collect()}
    return [got.get(i) for i in range(len(typed))]


def test_forms_and_edits(spark):
    same = ["tsx650f040-1d", "TSX650F040_1D sample 3", "Tessarac TSX650F040 1D #4", "tessarac devices tsx650f040-1d", "carrier TSX650F040-1D_DUT04", "Board-TSX 650F040 1D-die12", "TSX65OF040-1D (no. 7)", "SX650F040-1DX", "TXS650F040-1D"]
    assert answers(spark, [(d, None) for d in same]) == ["TSX650F040-1D"] * len(same)
    assert answers(spark, [("qld1_650_s150", None), ("QLD1-650-S150A_S22", None)]) == ["QLD1-650-S150A"] * 2


def test_no_answer(spark):
    typed = [(None, None), ("  ", None), ("TSX650F040-1D", None), ("TSX650F060-1D", None), ("AAX650F040-2D", None), ("golden sample", None)]
    assert answers(spark, typed) == [None, None, None, "UNMATCHED", "UNMATCHED", "UNMATCHED"]  # the fourth is equally near to two


def test_rules(spark):
    typed = [("Onyx 7", None), ("ONYX_20 DUT20", "baselines"), ("onyx20", "sc_ruggedness"), ("onyx #20", None), ("Board-LOT4A49", "avalanche"), ("LOT4-b12 (no. 3)", None), ("my LOT4-A49", None)]
    assert answers(spark, typed) == ["P1", "P2", "P3", "P1", "P4", "P4", "UNMATCHED"]


def test_repeats_and_empty(spark):
    assert answers(spark, [("onyx", None)] * 3) == ["P1"] * 3
    assert answers(spark, []) == []
    assert answers(spark, [("onyx", None), ("TSX650F040-1D", None)], library=[], rules=[]) == ["UNMATCHED", "UNMATCHED"]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        nxt = [i]
        for j, y in enumerate(b, 1):
            nxt.append(min(row[j] + 1, nxt[-1] + 1, row[j - 1] + (x != y)))
        row = nxt
    return row[-1]


@pytest.mark.parametrize("seed", [1, 2])
def test_pigeonhole_loses_nothing(spark, seed):
    rng = random.Random(seed)
    entries = sorted({"".join(rng.choice("ABC12") for _ in range(rng.randint(3, 9))) for _ in range(60)})
    typed = []
    for _ in range(150):
        s = list(rng.choice(entries))
        for _ in range(rng.randint(1, 3)):
            k = rng.randrange(len(s) + 1)
            s[k : k + rng.randint(0, 1)] = rng.choice(["", "A", "B", "2"])
        typed.append("".join(s))
    want = []
    for t in typed:
        near = sorted((edits(t, e), e) for e in entries)
        fit = near[0][0] <= canonical.K and (len(near) == 1 or near[1][0] > near[0][0])
        want.append(None if t in entries or not t else near[0][1] if fit else "UNMATCHED")
    assert answers(spark, [(t, None) for t in typed], [(e, None) for e in entries], []) == want


def test_short_entries_are_entries(spark):
    library = [("Q7", None), ("A", None), ("NH120R080T2B", None)]
    assert answers(spark, [("q-7", None), ("Q77", None), ("Q7XY", None), ("NH120R", None), ("Q7XYZ", None)], library) == ["Q7", "Q7", "Q7", "UNMATCHED", "UNMATCHED"]
