import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidegraph.llm import entities, kinds, orgnames, packing


def plain_distance(a, b):
    d = {(i, 0): i for i in range(len(a) + 1)} | {(0, j): j for j in range(len(b) + 1)}
    for i, j in itertools.product(range(1, len(a) + 1), range(1, len(b) + 1)):
        d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
        if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
            d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


def test_banded_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        for k in (0, 1, 2):
            assert entities.distance(a, b, k) == min(plain_distance(a, b), k + 1)


READER = orgnames.Reader(
    orgnames.Kinds(
        phrases=(("shipping",), ("shipbuilding",), ("towage",), ("port", "authority"), ("terminal", "operations"), ("classification", "society"), ("sea",)),
        endings=(("해운", "shipping"),),
        words=(("ops", "operations"), ("class", "classification"), ("soc", "society")),
    )
)


@pytest.mark.parametrize(
    ("name", "core", "kind", "unit"),
    [
        ("Hyondan Muran Shipping Co., Ltd.", "hyondanmuran", "shipping", ""),
        ("(주)무란쿠순헨로단해운 제7", "murankusunhenrodan", "shipping", "7"),
        ("c/o Bogun Rase Ship-building Inc.", "bogunrase", "shipbuilding", ""),
        ("BOGUN RASE P. Authority", "bogunrase", "port_authority", ""),
        ("Bogun Rase Terminal Ops. No. 2 Ltd", "bogunrase", "terminal_operations", "2"),
        ("Ｂ０gun　Räse　Class Soc", "bogunrase", "classification_society", ""),
        ("보군라세", "bogunrase", "", ""),
    ],
)
def test_reading(name, core, kind, unit):
    r = READER.read(name)[0]
    assert (r.core, r.kind, r.unit) == (core, kind, unit)


def test_no_reading():
    assert READER.read(None) == READER.read("  ") == READER.read("GKTO") == READER.read("Co., Ltd.") == []
    assert orgnames.Reader(orgnames.Kinds()).read("Bogun Rase Towage")[0] == orgnames.Reading(("bogun", "rase", "towage"), "", "", False)


def test_trade_name():
    assert [r.core for r in READER.read("Bogun Rase Towage t/a Terosin Sea")] == ["bogunrase", "terosin"]


@pytest.mark.parametrize("hot", [1, 4, 1000])
def test_segment_join_against_brute_force(spark, hot):
    rng = random.Random(hot)
    stems = ["gantanhen", "gantanhon", "munsunkogan", "bidokasu"]
    words = {"".join([rng.choice(["kodo", "mira", "tepo"]), rng.choice(stems)]) for _ in range(8)} | {rng.choice(stems) for _ in range(4)}
    for w in list(words):
        for _ in range(6):
            x = list(w)
            for _ in range(rng.randint(1, 2)):
                i = rng.randrange(len(x))
                x[i : i + rng.choice([0, 1])] = rng.choice(["", "a", "n", "ka"])
            words.add("".join(x))
    words = sorted(w for w in words if w)
    df = spark.createDataFrame([("t", w, w) for w in words], "block string, key string, s string")
    got = {tuple(sorted((r.a, r.b))) for r in entities.segment_join(df, df, both=False, hot_size=hot).collect()}

    def edit(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    sure = {(a, b) for a, b in itertools.combinations(words, 2) if edit(a, b) <= entities.edits(min(len(a), len(b)))}
    possible = {(a, b) for a, b in itertools.combinations(words, 2) if entities.same_spelling(a, b)}
    assert sure <= got <= possible


def others(start):
    """Organisations of other names, from which kinds can be learnt."""
    rows = []
    for kind, hangul, type_ in (("Towage", "예선", "TugOperator"), ("Shipping", "해운", "ShippingCompany"), ("Port Authority", "항만공사", "GovernmentAgency"), ("Classification Society", "선급", "ClassificationSociety")):
        for name, letters in (("Kumaro", "쿠마로"), ("Peditan", "페디탄"), ("Chowesu", "초웨수"), ("Nagihop", "나기홉"), ("Turobek", "투로벡")):
            rows.append((start + len(rows), f"{letters}{hangul}", f"{name}{kind.lower()[:2]} {kind} Ltd.", type_))
    rows += [(start + 100 + i, None, f"{n} Sea", None) for i, n in enumerate(("Wolkara", "Dipusan", "Gorbeti", "Famulin"))]
    return rows


ORGS = [
    (1, "보군라세예선", "Bogunra Senhin Towage Ltd.", "TugOperator"),
    (2, None, "Bogunra Senhin Towage", "TugOperator"),
    (3, None, "Senhin Bogunra Towage Inc.", "TugOperator"),
    (4, None, "Bogunra Senhin Shipping", "ShippingCompany"),
    (5, None, "Bogunra Senhin Towage No. 2", "TugOperator"),
    (6, "Terosin Sea", "Bogunra Senhin Towage", None),
    (7, None, "terosin sea", None),
    (8, None, "Bogunra Snhn Towage", None),
    (9, "", None, None),
    (10, "GKTO", None, "TugOperator"),
    (11, None, "Bogunra Senhin Ltd.", "ShippingCompany"),
]


def test_pairs(spark):
    orgs = spark.createDataFrame([(*o, "x") for o in [*ORGS, *others(1000)]], "org_id long, name string, name_en string, org_type string, id_a string")
    found = spark.createDataFrame([(10000, "Organization", "Bogunra S. Towage"), (10001, "Organization", "BogunSen Towage"), (10002, "Port", "Terosin Sea"), (10003, "Organization", None), (10004, "Organization", "Bogunra Senhin")], "relation_id long, target_type string, target_name string")
    pairs = lambda hot: {(r.id_a, r.id_b) for r in entities.organisation_pairs(entities.records(orgs, found), hot_rows=hot).collect()}
    same = [1, 2, 3, 6, 7, 8, 10000, 10001]
    want = {(a, b) for a, b in itertools.combinations(same, 2) if a < 10000} | {(4, 11)}
    assert pairs(2) == pairs(200_000) == want
    assert entities.organisation_pairs(entities.records(orgs.limit(0), found.limit(0))).count() == 0


def test_names_without_kinds(spark):
    orgs = spark.createDataFrame([(1, "Bogunra Senhin", None), (2, "Bogunra Senhim", None), (3, "Other Name", None), (4, None, "bogunra senhin ltd")], "org_id long, name string, name_en string").withColumn("org_type", F.lit(None).cast("string"))
    found = spark.createDataFrame([(9, "Organization", "Bogunra  Senhin")], "relation_id long, target_type string, target_name string")
    got = {(r.id_a, r.id_b) for r in entities.organisation_pairs(entities.records(orgs, found)).collect()}
    assert got == set(itertools.combinations((1, 2, 4, 9), 2))


def test_learnt_kinds(spark):
    heads = [f"{a}{b}{c}" for a in ("Wan", "Pol", "Gus", "Mir", "Tok") for b in ("ado", "esi", "ilu", "ora", "uke") for c in ("ban", "dem", "fir", "gol", "hun")]
    rows = others(1) + [(200 + i, None, f"{n} Towage Ltd.", None) for i, n in enumerate(heads)] + [(400 + i, None, f"{n} Towing Co., Ltd.", None) for i, n in enumerate(heads[:3])]
    df = spark.createDataFrame(rows, "org_id long, name string, english string, type string")
    got = kinds.learn(df.select(F.explode(F.array("name", "english")).alias("name")), df.select("name", "english", "type"))
    assert set(got.phrases) == {("towage",), ("shipping",), ("port", "authority"), ("classification", "society"), ("sea",)} and got.second == ("sea",)
    assert dict(got.endings) == {"예선": "towage", "해운": "shipping", "항만공사": "port_authority", "선급": "classification_society"}
    assert dict(got.words) == {"towing": "towage"}
    assert dict(got.types) == {"TugOperator": "towage", "ShippingCompany": "shipping", "GovernmentAgency": "port_authority", "ClassificationSociety": "classification_society"}
    assert kinds.learn(df.limit(0).select("name"), df.limit(0).select("name", "english", "type")) == orgnames.Kinds()


@pytest.mark.parametrize(("word", "full"), [("shpg", "shipping"), ("lgstcs", "logistics"), ("shipbldg", "shipbuilding"), ("auth", "authority"), ("authy", "authority"), ("ops", "operations"), ("towgae", "towage"), ("salvag", "salvage")])
def test_near_words(word, full):
    assert orgnames.near(word, full) and not orgnames.near(word, "terminal")


def test_rooms_find_the_tightest():
    sizes = [5, 3, 2]
    assert packing.best_fit([[0], [1]], [2], sizes, 7) == [[0, 2], [1]]


@pytest.mark.parametrize("shard", [40, 10_000])
def test_packing(spark, shard):
    rng = random.Random(2)
    sizes = [rng.randrange(0, 60) for _ in range(400)] + [100, 250, 0]
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)], "key long, size int, container_id string")
    rows = packing.pack(df, capacity=100, shard_items=shard).collect()
    held, per = {}, {}
    for r in rows:
        held[r.key] = held.get(r.key, 0) + r["size"]
        per[r.container_id] = per.get(r.container_id, 0) + r["size"]
    assert held == dict(enumerate(sizes)) and max(per.values()) <= 100
    assert all(sizes[r.key] > 100 for r in rows if r.piece_no)
    assert len(per) <= -(-sum(sizes) // 100) + 3
    assert packing.pack(df.limit(0)).count() == 0


def triplets(n, seed):
    """Items of which three always fill a bin of 1,000 exactly."""
    rng, out = random.Random(seed), []
    for _ in range(n):
        a = rng.randrange(380, 490)
        b = rng.randrange(190, (1000 - a) // 2)
        out += [a, b, 1000 - a - b]
    return out


def test_evolution_lowers_the_bins():
    saved = 0
    for seed in range(6):
        sizes = triplets(60, seed)
        first = packing.best_fit([], sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 1000)
        best, made = packing.evolve(sizes, 1000, [], str(seed))
        assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 1000 for b in best)
        assert len(first) > packing.least_bins(sizes, 1000) and made and len(best) <= len(first)
        saved += len(first) - len(best)
    assert saved > 0


def test_islands_better_the_first_packing(spark):
    sizes = triplets(120, 9)
    df = spark.createDataFrame([(i, 0, 0, s, i % 2) for i, s in enumerate(sizes)], "key long, piece_no int, start int, size int, shard int")
    rows = packing.best_packings(df, 1000, 0).collect()
    first, best = [{s: min(r.bins for r in rows if r.shard == s and (r.island < 0) == f) for s in (0, 1)} for f in (True, False)]
    assert max(r.crossovers for r in rows) > 0
    assert all(best[s] <= first[s] for s in (0, 1)) and sum(best.values()) < sum(first.values())
    easy = df.withColumn("size", F.lit(100))
    assert {r.island for r in packing.best_packings(easy, 1000, 0).collect()} == {-1}


def test_large_items_end_without_a_large_shard(spark, monkeypatch):
    held, most = packing.materialise, []

    def watched(df, label):
        out = held(df, label)
        if label.startswith("shards-"):
            most.append(out.groupBy("shard").count().agg(F.max("count")).first()[0])
        return out

    monkeypatch.setattr(packing, "materialise", watched)
    df = spark.range(3000).select(F.col("id").alias("key"), F.lit(60).alias("size"))
    assert packing.pack(df, 100, 200).select("container_id").distinct().count() == 3000
    assert len(most) <= 2 and max(most) < 300
