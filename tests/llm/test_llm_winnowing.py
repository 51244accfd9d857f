import random

import pytest
from fixtures import messy_documents, prose, SCHEMAS

from freshet.llm import winnowing


def deleted(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)]
    return {r["doc_id"]: (r["text"], r["__lines"]) for r in winnowing.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}


def test_passages_of_over_fifty_words(spark):
    passage, several = prose(1, 52), "\n".join(prose(k, 15) for k in range(10, 16))
    texts = [f"{prose(2, 30)}\n{passage}\n{prose(3, 30)}", f"{prose(4, 40)}\n{passage}", f"{several}\n{prose(5, 20)}", f"{prose(6, 20)}\n{several}", f"{passage}\n{several}", prose(1, 49), prose(7, 49) + "\n" + prose(1, 49)]
    got = deleted(spark, texts)
    assert got[0][0] == texts[0] and got[2][0] == texts[2]
    assert got[1] == (prose(4, 40), 1)
    assert got[3] == (prose(6, 20), 6)
    assert got[4] == ("", 7)
    assert got[5][0] == texts[5] and got[6][0] == texts[6]  # 49 words are no passage, nor are they with other neighbours


def test_repeats_inside_one_text(spark):
    line = prose(1, 60)
    assert deleted(spark, [f"{line}\nshort\n{line}\n{line}"])[0] == (f"{line}\nshort", 2)


def exact(texts, least=50):
    """Lines with a word that lie in a run of ``least`` words which occurred before: what must go."""
    seen, must = set(), []
    for text in texts:
        _, hashes, words = winnowing.line_keys(text.encode())
        own = set()
        for k in range(len(words)):
            end, held = k, 0
            while end < len(words) and held < least:
                held += words[end]
                end += 1
            if held >= least:
                gram = tuple(hashes[k:end])
                if gram in seen:
                    own.update(range(k, end))
                seen.add(gram)
        must.append(own)
    return must


def test_against_brute_force(spark):
    """Runs with fifty words in two lines, or in more and a line besides, all go; of what goes, each line stands before."""
    pick = random.Random(3)
    pool = [prose(100 + k, pick.choice([8, 20, 55])) for k in range(40)]
    chunks = [[pick.choice(pool) for _ in range(8)] for _ in range(12)]
    texts = []
    for k in range(60):
        lines = [prose(1000 + 10 * k + j, 12) for j in range(4)]
        at = pick.randrange(5)
        texts.append("\n".join(lines[:at] + pick.choice(chunks) + lines[at:]))
    got = deleted(spark, texts)
    seen = set()
    for k, (text, must) in enumerate(zip(texts, exact(texts), strict=True)):
        lines = text.split("\n")
        left = got[k][0].split("\n") if got[k][0] else []
        assert len(lines) - len(left) == got[k][1] >= len(must)
        for line in set(lines) - set(left):
            assert line in seen or lines.count(line) > 1
        seen.update(lines)


def test_messy_documents_and_order(spark):
    docs = spark.createDataFrame(messy_documents(), SCHEMAS["documents"])
    got = winnowing.dedup_lines(docs)
    assert got.columns == [*docs.columns, "__lines", "__words", "__left"]
    rows = got.collect()
    assert len(rows) == docs.count()
    assert [r["text"] for r in rows if r["doc_id"] == 0] == [None]
    first = [r["text"] for r in rows if r["doc_id"] == 8]
    assert first == [prose(4, 60)]  # its own repeats went, the first occurrence of all stayed
    assert [r["text"] for r in rows if r["doc_id"] == 9] == [prose(5, 70)]
    kept = winnowing.keep_first_lines(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0


@pytest.mark.parametrize("shape", [(20,) * 3, (15,) * 4, (11,) * 5, (8,) * 7, (6,) * 10, (30, 30), (60,)])
def test_every_shape_of_passage_is_found_beside_any_lines(spark, shape):
    texts = []
    for k in range(40):
        passage = "\n".join(prose(1000 * k + j, n) for j, n in enumerate(shape))
        beside = [prose(10**6 + 10 * k + j, 60 if k % 2 else 5) for j in range(4)]
        texts += [f"{beside[0]}\n{passage}\n{beside[1]}", f"{beside[2]}\n{passage}\n{beside[3]}"]
    got = deleted(spark, texts)
    assert [got[k][1] for k in range(80)] == [0, len(shape)] * 40


def test_just_the_lines_of_repeated_runs_go(spark):
    """Both ways of brute force; runs of whose parts the first occurrences are in different documents."""
    pick = random.Random(7)
    pool = [prose(100 + k, pick.choice([6, 20, 30, 60])) for k in range(12)]
    texts = ["\n".join(pick.choice(pool) if pick.random() < 0.8 else prose(5000 + 20 * k + j, 12) for j in range(9)) for k in range(60)]
    got = deleted(spark, texts)
    back = exact_both(texts)
    assert any(back)
    assert [got[k][1] for k in range(60)] == [len(m) for m in back]


def exact_both(texts, least=50):
    """``exact`` over every run of lines that holds the words."""
    seen, must = set(), []
    for text in texts:
        _, hashes, words = winnowing.line_keys(text.encode())
        own = set()
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                if sum(words[a:b]) >= least:
                    own.update(range(a, b) if tuple(hashes[a:b]) in seen else ())
                    seen.add(tuple(hashes[a:b]))
        must.append(own)
    return must


def test_a_later_occurrence_may_hold_more(spark):
    """A holds P; B and C hold P and Q: all of C goes, as it stands in B."""
    p, q = prose(1, 60), prose(2, 20) + "\n" + prose(3, 20)
    got = deleted(spark, [f"{p}\n{prose(4, 30)}", f"{prose(5, 30)}\n{p}\n{q}", f"{prose(6, 30)}\n{p}\n{q}\n{prose(7, 30)}"])
    assert got[1] == (f"{prose(5, 30)}\n{q}", 1)
    assert got[2] == (f"{prose(6, 30)}\n{prose(7, 30)}", 3)
