"""The fuzzy queries take the names of the concepts, each once."""

from oracle import DATA, connect

from boscograph import catalogue
from boscograph.operators.resolve import ratio
from boscograph.plans import lens

SF = f"{DATA}/sf0.001"


def test_fuzzy_pairs_of_all_names(spark):
    names = sorted(x for (x,) in connect("sf0.001").sql(f"with {lens.C} select distinct entity from c").fetchall())
    got = {tuple(sorted((r.na, r.nb))) for r in catalogue.QUERIES["kg_fuzzy_pairs"](spark, SF).collect()}
    near = lambda a, b: 1.15 * min(len(a), len(b)) >= 0.85 * max(len(a), len(b))
    assert got and got <= {(a, b) for a in names for b in names if a < b}
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            if near(a, b):
                r = max(ratio(a, b), ratio(b, a)), min(ratio(a, b), ratio(b, a))
                assert r[1] < 0.85 or (a, b) in got, (a, b)
                assert r[0] >= 0.85 - 1e-9 or (a, b) not in got, (a, b)
    kept = catalogue.QUERIES["kg_fuzzy_dedup"](spark, SF).collect()
    assert sum(r.n for r in kept) == len(names)
