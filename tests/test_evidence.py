import random

from quarryline.operators import evidence, summaries
from quarryline.plans.flow_fixtures import APP


def plain_pack(rows, budget, shares):
    out = []
    for key in {r[0] for r in rows}:
        fits = []
        for kind in sorted(shares):
            used = 0
            for r in sorted(r for r in rows if r[0] == key and r[1] == kind):
                used += len(r[3].encode()) + 1
                if used > int(shares[kind] * budget):
                    break
                fits.append(r)
        used = 0
        for r in fits:
            used += len(r[3].encode()) + 1
            if used > budget:
                break
            out.append(r)
    return sorted(out)


def test_packing_equals_plain(spark):
    rng = random.Random(6)
    rows = [(k, rng.randrange(4), f"{i:04d}", "é" * rng.randint(0, 12)) for i, k in enumerate(rng.choices("abh", [1, 1, 6], k=400))]
    df = spark.createDataFrame(rows, "hit string, kind int, at string, line string")
    for budget in (1, 30, 200):
        got = sorted(map(tuple, evidence.packed(df, "hit", budget).collect()))
        assert got == plain_pack(rows, budget, evidence.SHARES) and sum(len(r[3].encode()) + 1 for r in got if r[0] == "h") <= budget


SHOP = """\
class Base:
    def reset(self):
        self.total = 0

class Shop(Base):
    def add(self, x):
        self.total += x
        log(x)

    def show(self):
        if self.total == 1:
            return render(self.total)

    def clear(self):
        self.total = None
        self.other = self.total

def render(x):
    y = x
    return y

def page(shop):
    s = Shop()
    s.show()
"""


def test_kinds_of_evidence(spark):
    files = spark.createDataFrame([("s.py", "python", SHOP), ("app.py", "python", APP)], "path string, lang string, content string")
    found = summaries.functions(files)
    edges = summaries.call_edges(found)
    hits = spark.createDataFrame([("h", "s.py::Shop.show", 12)], "hit string, node string, line_no int")
    parents = spark.createDataFrame([("s.py::Shop", "s.py::Base")], "class string, parent string")
    got = [(r["kind"], r["at"].split("::")[1], r["line"].strip()) for r in evidence.evidence(hits, found, edges, parents, before=1, after=3).orderBy("kind", "at").collect()]
    assert got == [
        (0, "Shop.show:000000011", "if self.total == 1:"),
        (0, "Shop.show:000000012", "return render(self.total)"),
        (1, "Base.reset:000000003", "self.total = 0"),
        (1, "Shop.add:000000007", "self.total += x"),
        (1, "Shop.clear:000000015", "self.total = None"),
        (2, "page:000000024", "s.show()"),
        (3, "render:000000018", "def render(x):"),
        (3, "render:000000019", "y = x"),
        (3, "render:000000020", "return y"),
    ]
    few = evidence.evidence(hits, found, edges, budget=90).collect()
    assert {r["kind"] for r in few} == {0, 1, 2} and sum(len(r["line"]) + 1 for r in few) <= 90
