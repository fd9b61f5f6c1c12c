"""Facts found inside a record's row: the same as over long rows, and without their shuffles."""

import pytest
from pyspark.sql import functions as F

from quirelake.operators import field_facts, manuscripts
from quirelake.plans import queries, records

DATA = "/root/testdata/sf0.001"


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("name", ["record_facts", "fact_statistics", "manuscript_labels", "manuscript_claims", "record_graph"])
def test_no_shuffle_by_record(spark, name):
    """Only orders and customers meet, base rows are dealt, and counts are gathered by value: subfields and facts stay in their rows."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    shuffles = [line.split("hashpartitioning(")[1] for line in plan.splitlines() if "Exchange hashpartitioning(" in line]
    assert not [x for x in shuffles if x.startswith("control_number")]


def test_rows_of_records_equal_long_rows(spark):
    columns = ["control_number", "tag", "field_ord", "kind", "n", "key", "value"]
    few = F.col("control_number") < "2"
    by_row = field_facts.each(records._facts(spark, DATA)).where(few).select(*columns)
    by_long = field_facts.facts(records.long_rows(spark, DATA).where(few)).select(*columns)
    got = as_rows(by_row)
    assert got and got == as_rows(by_long)


def test_predicates_counted_inside_records(spark):
    rows = [("1", "100", 1, "a", 0, "A"), ("1", "700", 2, "a", 0, "A"), ("1", "245", 3, "a", 0, "T"), ("2", "100", 1, "a", 0, "A"), ("2", "245", 3, "a", 0, "T"), ("2", "041", 4, "a", 0, "hebger")]
    long = spark.createDataFrame(rows, "control_number string, tag string, field_ord int, code string, sub_ord int, value string")
    facts = field_facts.record_facts(field_facts.records(long)).cache()
    triples = manuscripts.fact_triples(field_facts.each(facts))
    wanted = triples.groupBy("p").agg(F.count("*").alias("n"), F.count_distinct("s").alias("subjects"), F.count_distinct("o").alias("objects"))
    got = as_rows(manuscripts.predicate_counts(facts))
    assert got == as_rows(wanted) and ("has_person", 3, 2, 3) in got


def test_no_key_is_the_predicate_of_a_link():
    assert not {f"has_{kind}" for _, kind, *_ in records.WANTED} & {key for *_, key, _ in records.WANTED}


@pytest.mark.parametrize("name", ["record_facts", "manuscript_labels", "manuscript_claims"])
def test_records_are_dealt_to_all_tasks(spark, name):
    """A stated number of partitions: adaptive execution would join those of few bytes, though each record costs a millisecond."""
    plan = queries.QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan


NOTE = "Incipit: the words that open it. Later hand, corrections; unit 7 part 2 ff. 5r-9v; Genesis 3:5 and Yoma 12b; Ashkenazi square"
REPEATED = [
    ("500", 1, (("a", NOTE),)), ("500", 2, (("a", "פותח: ראשון שני שלישי; תיקונים, יחידה 3"),)), ("500", 3, (("a", ""),)), ("700", 4, (("a", "One"), ("e", "Scribe."), ("d", "1100-1150"))), ("700", 5, (("a", "Two"), ("4", "aut"), ("d", "fl. 1120"))), ("700", 6, ()),
    ("041", 7, (("h", "ger"), ("a", "hebara"))), ("041", 8, (("a", "heb"), ("b", ""))), ("300", 9, (("a", "12 leaves"), ("c", "28 x 20 cm"))), ("300", 10, (("a", "3 volumes"),)), ("505", 11, (("a", "f 9r Work; xy; Other f12"), ("t", "T"), ("g", "f. 1"))), ("505", 12, (("t", "U"), ("r", "R"))),
    ("546", 13, ()), ("546", 14, (("a", "pointed"),)), ("600", 15, (("a", "S"), ("d", "1200"))), ("600", 16, (("a", "S"),)), ("008", 17, (("", "000000s1992    is " + " " * 17 + "heb  "),)), ("008", 18, (("", "short"),)), ("999", 19, (("a", "none"),)), ("852", 20, (("h", "H"),)), ("852", 21, (("j", "J"), ("h", "H"))),
]


def test_first_and_further_fields_of_a_tag_give_the_same_facts(spark):
    """All in one record, where most go through lambdas, and each in a record of its own, where all are columns."""
    schema = "control_number string, fields array<struct<tag:string,field_ord:int,subs:array<struct<sub_ord:int,code:string,value:string>>>>"
    fields = [(tag, n, [(k, *x) for k, x in enumerate(subs)]) for tag, n, subs in REPEATED]
    together, alone = spark.createDataFrame([("r", fields)], schema), spark.createDataFrame([("r", [f]) for f in fields], schema)
    of = lambda df, **x: as_rows(field_facts.each(field_facts.record_facts(df, **x)))
    got = of(together)
    assert got == of(alone) and {r[2] for r in got} == set(range(1, 22)) - {3, 18, 19}
    wanted = [("note", "incipit"), ("person", "name"), ("content", "title")]
    assert of(together, wanted=wanted) == [r for r in got if (r[3], r[5]) in wanted]


def test_only_wanted_facts_are_looked_for(spark):
    plan = queries.QUERIES["manuscript_labels"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "incipit" not in plan and "Talmud_Bavli" not in plan
