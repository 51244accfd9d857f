import random
import re

import pytest
from fixtures import messy_documents, prose, SCHEMAS

from freshet.llm import quality


def naive(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    inside = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), sum(x in lines[:k] for k, x in enumerate(lines)), len(inside)


@pytest.mark.parametrize("seed", range(20))
def test_measures_against_counting(seed):
    pick = random.Random(seed)
    text = "".join(pick.choice(["a", "b ", "c\n", "\n", "# ", "é漢 ", "\r\n", " ", "|<", "x y z "]) for _ in range(pick.randrange(120)))
    assert quality.measure(text.encode())[0] == naive(text)


def test_line_words_of_equal_lines_add_up():
    assert sorted(quality.measure(b"A  b\na b\n\nc")[1].values()) == [1, 4]


def test_boilerplate_goes_and_depleted_documents_are_rejected(spark):
    notice = prose(1, 60)
    rows = [(k, f"{prose(100 + k, 80)}\n{notice.upper() if k % 2 else notice}", "h") for k in range(40)]
    rows += [(100, f"{prose(200, 50)}\n{notice}\n{notice}", "h"), (101, f"{notice}\n{prose(201, 55)}", "g"), (102, notice, "h"), (103, prose(202, 60), "h")]
    got = {r["id"]: r for r in quality.line_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(got[k]["removed_words"] == 60 and got[k]["kept"] for k in range(40))
    assert (got[100]["removed_words"], got[100]["kept"]) == (120, False)
    assert (got[101]["removed_words"], got[101]["kept"]) == (0, True)  # another host
    assert (got[102]["removed_words"], got[102]["kept"], got[102]["base_failed"]) == (60, False, False)
    assert (got[103]["removed_words"], got[103]["kept"]) == (0, True)


def test_limit_grows_with_the_host(spark):
    """More than 30 documents and more than a share of the host's have to hold a line."""
    rows = [(k, prose(k, 60) + ("\ncommon line" if k < 31 else ""), "h") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    assert quality.line_rules(docs).where("removed_words > 0").count() == 31
    assert quality.line_rules(docs, share=0.9).where("removed_words > 0").count() == 0


def test_messy_documents(spark):
    rows = messy_documents()
    got = quality.line_rules(spark.createDataFrame(rows, SCHEMAS["documents"])).collect()
    want = [(r[0], *(naive(r[1]) if len(r[1] or "") < 9999 else quality.measure(r[1].encode())[0])) for r in rows]
    assert sorted(((r["id"], *(r[m] for m in quality.MEASURES)) for r in got), key=repr) == sorted(want, key=repr)
    assert not any(r["kept"] for r in got if r["base_failed"])
