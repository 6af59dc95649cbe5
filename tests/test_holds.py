"""Words that are looked for before a pattern: none of what a pattern finds may be lost. Before, patterns were tried at each place of every text."""

import itertools
import re

import pytest

from tessera.functions import fixed
from tessera.plans import money
from tessera.plans.dialect import DUCK, SPARK

WORDS = "refund refunded credited back subscription renew renews renewal membership auto-pay autopay mandate amount due date bill of is pay by payment received successful paid debited spent transaction week month quarter year annually monthly".split()
WORDS += "next billing charge auto-debit autodebit will be charged on 5 November 2024-02-03 order total grand summary confirmed placed invoice receipt billed purchase 70% off sale ends shop now deal the day starting at starts only for you use code coupon up to".split()


@pytest.mark.parametrize("pattern", list(fixed.HOLDS), ids=lambda p: p[:30])
def test_what_a_pattern_finds_holds_a_word(pattern):
    texts = [sep.join(w) for n in (1, 2, 3) for w in itertools.permutations(WORDS, n) for sep in ((" ", "") if n < 3 else (" ",))]
    found = [t for x in texts for t in (x, x.upper()) if re.search(pattern, t if "(?i)" in pattern else t.lower())]
    assert found
    assert [t for t in found if not any(w in t.lower() for w in fixed.HOLDS[pattern])] == []


def test_amounts_stand_near_digits():
    signs = [*fixed.BEFORE.replace("\\", "").replace("?", "").split("|"), "Rs", "RS.", *fixed.AFTER.split("|"), "INR", "", "x"]
    token = money.TOKEN.replace(r"\pL\pN", r"^\W_")  # Python has no \pL
    token = re.sub(r"\[\^\^\\W_(_\.,?)\]", r"(?:\\W)", token)
    for a, b, gap, number in itertools.product(signs, signs, ("", " "), ("5", "1,24,999.50", "7.", "8,")):
        line = f"x {a}{gap}{number}{gap}{b}"
        assert not re.search(token, line) or re.search(fixed.NEAR_DIGITS, line), line


def test_spark_alone_looks_for_words():
    assert money.kind(SPARK, "text").count("contains(") == sum(len(fixed.HOLDS[p]) for p in (fixed.KIND_REFUND, fixed.KIND_SUBSCRIPTION, fixed.KIND_BILL, fixed.KIND_SETTLED, fixed.KIND_DEBIT))
    assert "contains(" not in money.kind(DUCK, "text")
