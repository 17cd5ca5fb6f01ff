from tests.llm.test_names import others
from tidegraph.llm import entities


def test_short_names_by_typings(spark):
    orgs = [(i, None, "Jindan Kemin Classification Society", "ClassificationSociety") for i in (1, 2, 3)] + [(i, None, "Bogun Rase Towage", "TugOperator") for i in (4, 5, 6)] + others(1000)
    orgs = spark.createDataFrame(orgs, "org_id long, name string, name_en string, org_type string")
    found = [
        (100, "s1", "Jindan Kaemin Classification Society"), (101, "s1", "Jindan Kaemin Classification Society"), (102, "s2", "Jindan Kaemin Classification Society"),  # one edit, typed twice
        (103, "s1", "Jndan Kmin Classification Society"), (104, "s1", "Jndan Kmin Classification Society"),  # two edits, typed once and extracted twice, beside four right ones
        (107, "s3", "Jindan Kemin Classification Society"),
        (105, "s1", "Bokun Rabe Towage"), (106, "s2", "Bokun Rabe Towage"),  # another organisation
    ]
    found = spark.createDataFrame([(r, s, "Organization", n) for r, s, n in found], "relation_id long, source_id string, target_type string, target_name string")
    got = {(r.id_a, r.id_b) for r in entities.organisation_pairs(entities.records(orgs, found)).collect()}
    one, two = [1, 2, 3, 100, 101, 102, 103, 104, 107], [4, 5, 6]
    assert got == {(a, b) for g in (one, two) for a in g for b in g if a < b and a < 100}
