"""Domains and account numbers of surrogates."""

import re

from quirelake.llm import pii_surrogates

EMAIL = re.compile(r"[\w.]+@[\w.]+")


def test_domains_are_entities(spark):
    """Many short domains: distinct surrogates, none of them real, one for all addresses of a domain."""
    letters = "abcdefghij"
    domains = [f"{a}{b}.de" for a in letters for b in letters]
    rows = [(k, f"write to {who}.lane@{d} soon") for k, d in enumerate(domains) for who in ("ann", "bob")]
    got = pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    found: dict = {}
    for r in got:
        [address] = EMAIL.findall(r["text"])
        found.setdefault(r["doc_id"], set()).add(address)
    own = {k: {a.split("@")[1] for a in v} for k, v in found.items()}
    assert all(len(v) == 2 for v in found.values()) and all(len(v) == 1 for v in own.values())
    drawn = [next(iter(v)) for v in own.values()]
    assert len(set(drawn)) == len(domains) and not set(drawn) & set(domains)


def test_account_numbers_stay_valid(spark):
    valid, broken = "DE89370400440532013000", "DE88370400440532013000"
    number = lambda s: int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97
    assert number(valid) == 1 != number(broken)
    rows = [(1, f"pay {valid} now"), (2, "pay GB29 NWBK 6016 1331 9268 19 now"), (3, f"pay {broken} now")]
    got = {r["doc_id"]: r["text"][4:-4].replace(" ", "") for r in pii_surrogates.replace_entities(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] != valid and got[1][:2] == "DE" and number(got[1]) == 1
    assert got[2][:2] == "GB" and got[2] != "GB29NWBK60161331926819" and number(got[2]) == 1
    assert got[3] != broken and len(got[3]) == len(broken)
