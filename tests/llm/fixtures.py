"""Small tables in the shape of the driver's, with what they may hold at worst."""

import random

SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, id string, fp string, shard string, row string, host string, gram string, __id string",
    "labels": "doc_id long, quality long, toxic long, score string",
    "pages": "page_id long, url string, html string, sha string, type string",
    "benchmark": "item_id long, text string, item string, shingle string",
}
WORDS = "the a river stone walks over green hills when light falls and birds sing near old mills under quiet skies for long".split()


def prose(seed: int, n: int) -> str:
    pick = random.Random(seed)
    return " ".join(pick.choice(WORDS) + str(pick.randrange(60)) for _ in range(n))


def messy_documents() -> list[tuple]:
    """Nulls, blanks, copies, repeated rows and ids, one very long text; the last columns only clash by name."""
    texts = [None, "", "   \n\t", "one", prose(1, 80), prose(1, 80), prose(2, 300), prose(3, 30_000), "\n".join([prose(4, 60)] * 3), prose(5, 70) + "\n" + prose(4, 60), "x " * 400, "漢字 🙂 naïve ▁ text\r\n" + prose(6, 60)]
    rows = [(k, t, "en" if k % 3 else None, f"s{k % 2}" if k % 4 else None, len(t or "")) for k, t in enumerate(texts)]
    rows += [rows[4], rows[4], (None, texts[6], None, None, None), (None, None, None, None, None), (4, prose(7, 90), "en", "s0", 5)]
    return [(*r, "c", "c", "c", "c", "c", "c", "c") for r in rows]


def messy_tables() -> dict[str, list[tuple]]:
    html = "<html lang='en'><body>" + prose(8, 300) + "</body></html>"
    return {
        "documents": messy_documents(),
        "labels": [(0, 1, 0, "c"), (4, 0, 1, "c"), (4, 0, 0, "c"), (5, None, None, "c"), (None, 1, 1, "c"), (6, 1, 0, "c"), (999, 1, 1, "c")],
        "pages": [(1, "http://a.example/x y", html, "c", "c"), (2, None, html, "c", "c"), (2, None, html, "c", "c"), (3, "ü", None, "c", "c"), (None, "http://b.example.de/", "<p>kurz</p>", "c", "c"), (5, "http://a.example/", "", "c", "c"), (None, None, None, None, None)],
        "benchmark": [(1, prose(3, 30_000)[:400], "c", "c"), (2, None, "c", "c"), (3, "", "c", "c"), (4, "one", "c", "c"), (4, "one", "c", "c"), (None, prose(2, 300)[:200], "c", "c")],
    }


def write_tables(spark, folder, tables: dict[str, list[tuple]]) -> str:
    for name, rows in tables.items():
        spark.createDataFrame(rows, SCHEMAS[name]).coalesce(2).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
