import random
import re
import unicodedata
import zipfile

import pytest
from pyspark.sql import functions as F

from leafmill.functions import cleaning, lexicon, markup, quality
from leafmill.functions.text import rule_text
from leafmill.operators import organise, rules, search, store, tags, vectors
from leafmill.sources import files
from leafmill.streaming import jobs as streams


def one(spark, expr, **columns):
    row = spark.createDataFrame([tuple(columns.values())], list(columns)) if columns else spark.range(1)
    return row.select(expr.alias("x")).head()["x"]


@pytest.mark.parametrize(("word", "kind"), [("BCS303", "identifier"), ("uniks5", "unknown-noisy"), ("qonevade", "noise"), ("the", "stop"), ("turing", "domain"), ("deadline", "dictionary"), ("", "empty"), ("maths4", "identifier")])
def test_signals(spark, word, kind):
    assert one(spark, lexicon.signal(F.col("w")), w=word) == kind


def test_quality_of_texts(spark):
    rows = spark.createDataFrame([(1, "Hello, world 12"), (2, ""), (3, None), (4, "a b aaaaa ok")], "id int, t string")
    got = {r["id"]: tuple(r)[1:] for r in rows.select("id", quality.words(F.col("t")).alias("w")).select("id", *quality.analysed(F.col("w"))).collect()}
    assert got == {1: (3, 0.0, 100), 2: (0, 1.0, 0), 3: (0, 1.0, 0), 4: (4, 0.75, 25)}


def test_cleaning_keeps_first_lines_and_drops_signs(spark):
    rows = spark.createDataFrame([("One  line .\n***\n\none line.\n“Two”\xa0( x )\n",), (None,)], "text string")
    assert [r["clean_lines"] for r in cleaning.cleaned(rows).collect()] == [["One line.", '"Two" (x)'], []]


def test_ordinary_words_are_no_noise(spark):
    words = ["a", "1", "ab", "aaaa", "aaaaa", "aaaaa.", "aaaaab", "x" * 48, "ab" * 23 + "c", "ab" * 23 + "c.", "ab" * 24, "ab" * 24 + ".", "a.b.c.d.", "abcdefgh..", "é", "ßß", "a..", "--"]
    n, bare = F.length("w"), F.length(F.regexp_replace("w", r"[\p{L}\p{N}]", ""))
    noise = ((n == 1) & ~F.col("w").rlike(r"^\d$")) | (n > 48) | F.col("w").rlike(r"^(.)\1{4,}$") | (bare == n) | ((n >= 8) & (bare / n > 0.45))
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", noise.alias("noise"), quality.is_noise(F.col("w")).alias("got"), F.col("w").rlike(quality.ORDINARY).alias("ordinary")).collect()
    assert all(r["noise"] == r["got"] and not (r["noise"] and r["ordinary"]) for r in rows)
    assert {r["w"] for r in rows if r["ordinary"]} >= {"ab", "aaaa", "aaaaa.", "ßß"}


def test_texts_that_stay_as_they_are_need_no_python(spark):
    chars = spark.createDataFrame([(chr(n),) for n in range(0xA0, 0x3100)], "c string")
    stable = [r["c"] for r in chars.filter(F.col("c").rlike(cleaning.STABLE)).collect()]
    assert {"é", "ß", "“", "—", "ž"} <= set(stable) and not {"\xa0", "ſ", "ŀ", "²", "\u0301", "ﬁ"} & set(stable)
    assert all(unicodedata.normalize("NFKC", c) == c and not unicodedata.combining(c) for c in stable)
    assert all(unicodedata.normalize("NFKC", a + b) == a + b for a in [*stable, "e", "="] for b in stable)
    texts = ["Žluťoučký “kůň” – Straße", "e\u0301\xa0ﬁ", None, "²"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaning.compatible(F.col("t")).alias("c")).collect()
    assert [r["c"] for r in rows] == [t if t is None else unicodedata.normalize("NFKC", t) for t in texts]


def test_blanks_by_signs_go_as_by_one_pattern(spark):
    rnd = random.Random(5)
    texts = ["".join(rnd.choice("ab.,)]}([{ \t\n\x0b\x0c\u2028\ufeffé“—" if i % 2 else "ab,)([ ") for _ in range(rnd.randint(0, 30))) for i in range(600)]
    plain = F.translate("t", "“—", '"-')
    one_by_one = F.regexp_replace(F.regexp_replace(plain, rf"{cleaning.INLINE}++(?=[,.;:!?)\]}}])|(?<=[(\[{{]){cleaning.INLINE}++", ""), r"[ \t]{2,}+", " ")
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cleaning.spaces_normalised(F.col("t")).alias("got"), one_by_one.alias("want"))
    assert all(r["got"] == r["want"] for r in rows.collect())
    # no look behind each sign, and doubled blanks are looked for by a pattern in texts that have some
    plan = rows.select("got")._jdf.queryExecution().optimizedPlan().toString()
    assert "(?<=" not in plan and re.search(r"CASE WHEN \(Contains\(t#\d+,   \)", plan)


def test_entities_decode_in_order(spark):
    assert one(spark, markup.entities(F.col("t")), t="a &amp;lt; b &#65;&#x42;") == "a < b AB"


def test_noisy_text_gives_its_keywords(spark):
    text = "Tusing wachine has a tepe and oulput. BCS303 unit5 qonevade fhe uniks5 bnx0"
    got = {r["tag"] for r in tags.keyword_tags(spark.createDataFrame([(1, text)], "doc_id long, text string")).collect()}
    assert {"turing", "machine", "output", "bcs303", "unit5"} <= got and not {"fhe", "qonevade", "uniks5"} & got


def test_category_ties_go_to_the_first(spark):
    assert one(spark, tags.category(F.col("t")), t="education and a system") == "Resume"
    assert one(spark, tags.category(F.col("t")), t="nothing") == "Unknown"


def test_next_line(spark):
    docs = spark.createDataFrame([(1, "Name\n\nAda\nfilename\nBob"), (2, "x\nname"), (3, None)], "doc_id long, text string")
    assert {r[0]: r[1] for r in tags.next_line_value(docs, "name").collect()} == {1: "Bob", 2: None, 3: None}


def test_next_line_without_blanks_of_any_width(spark):
    docs = spark.createDataFrame([(1, "name\n\xa0\u3000\n\u2003Bob\xa0 \nx"), (2, "name\n\tBob\u200b")], "doc_id long, text string")
    assert {r[0]: r[1] for r in tags.next_line_value(docs, "name").collect()} == {1: "Bob", 2: "\tBob\u200b"}


def suggest(spark, name, text, quality_=90, words=100, **more):
    docs = spark.createDataFrame([(1, name, "/x/" + name, "Unknown", text, quality_, words)], "doc_id long, file_name string, file_path string, category string, clean_text string, quality int, word_count int")
    return organise.suggested(docs, **more).head()


def test_suggested_folders(spark):
    r = suggest(spark, "toc.pdf", "notes chapter on the turing machine and automata with finite control")
    assert (r["document_type"], r["subject"], r["primary_folder"], r["review"]) == ("notes-book", "theory-of-computation", "notes-theory-of-computation", False)
    assert r["folder_ids"][:2] == ["notes-theory-of-computation", "notes-books"]
    weak = suggest(spark, "scan.png", "", 20, 3)
    assert weak["primary_folder"] == "review-needed" and weak["top_folder"] == "images"
    edits = spark.createDataFrame([("medical", "yoga", "positive", 1.0), ("certificates", "yoga", "ignored", 3.0)], "folder_id string, keyword string, role string, weight double")
    moved = suggest(spark, "scan.png", "yoga", overrides=edits)
    assert moved["top_folder"] == "medical" and moved["top_score"] == 12


def test_terms_are_substrings(spark):
    assert one(spark, organise.has_term(rule_text(F.col("t")), "nta"), t="mental")
    assert one(spark, organise.has_term(rule_text(F.col("t")), "bcs303"), t="BCS 303")


def test_tree():
    flat = rules.flat_folders()
    assert len(flat) == 46 and flat[3][3] == "Exam Papers / JEE"


def test_query_tokens_and_columns_agree(spark):
    for q in ("BCS303 the unit 04", "12ab Ünï a", ""):
        assert one(spark, search.tokens(F.col("t")), t=q) == search.query_tokens(q)


def test_search_needs_all_words_and_falls_back(spark):
    docs = spark.createDataFrame([(1, "a.pdf", "turing machine notes"), (2, "b.pdf", "machine"), (3, "c.pdf", "turimg machime")], "doc_id long, file_name string, text string")
    assert [r["doc_id"] for r in search.two_stage(docs, "turing machine").collect()] == [1]
    # no document has turinx; six letters may differ by two edits in recognised text, and only 1 and 3 match both words
    assert {r["doc_id"] for r in search.two_stage(docs, "turinx machine").collect()} == {1, 3}
    assert search.searched(docs, " ").count() == 0


def test_snippet(spark):
    assert one(spark, search.snippet(F.col("t"), "zz ada"), t="x" * 60 + "Ada" + "y" * 200) == "x" * 50 + "Ada" + "y" * 97
    assert one(spark, search.snippet(F.col("t"), "zz"), t="abc") == ""


def test_hybrid(spark):
    lex = spark.createDataFrame([(1, 10.0), (2, 5.0)], "doc_id long, score double")
    sem = spark.createDataFrame([(2, 0.5), (3, 0.25)], "doc_id long, similarity double")
    assert {r[0]: r[1] for r in search.hybrid(lex, sem).collect()} == {1: 10.0, 2: 55.0, 3: 25.0}


def test_vectors(spark):
    rows = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r[0], r[1]) for r in vectors.top_k(rows, [2.0, 0.0], 2).collect()] == [(1, 1.0), (3, 0.7071)]
    bad = spark.createDataFrame([([1.0, float("nan")],)], "v array<double>")
    assert bad.select(vectors.stored_form(F.col("v"))).head()[0] is None


def test_upsert_and_overrides(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert {(r[0], r[1]) for r in store.upserted(old, new, ["k"]).collect()} == {(1, "a"), (2, "c"), (3, "d")}
    assert {(r[0], r[1]) for r in store.inserted_if_absent(old, new, ["k"]).collect()} == {(1, "a"), (2, "b"), (3, "d")}


def test_queue_ends_with_failed_jobs(spark, tmp_path):
    jobs = spark.createDataFrame([(f"j{i}", "d", i, "pending", 0, i, None) for i in range(3)], "job_id string, document_id string, page_number int, status string, attempts int, created_at int, error string")
    work = lambda claimed: claimed.select("job_id", (F.col("page_number") != 1).alias("ok"), F.lit("text").alias("text"), F.lit("boom").alias("error"))
    done, left = streams.drained(jobs, work, str(tmp_path), 2)
    assert sorted(r["page_number"] for r in done.collect()) == [0, 2]
    assert [(r["job_id"], r["status"], r["attempts"]) for r in left.collect()] == [("j1", "failed", 3)]


def test_files(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.md").write_text("hello  \nworld")
    (tmp_path / "b.txt").write_bytes(b"x\0y")
    (tmp_path / "c.bin").write_bytes(b"no")
    with zipfile.ZipFile(tmp_path / "d.pptx", "w") as z:
        for i in (10, 2):
            z.writestr(f"ppt/slides/slide{i}.xml", f"<a>slide &amp; {i}</a>")
    (tmp_path / "e.docx").write_bytes(b"broken")
    rows = files.extracted(files.scan(spark, str(tmp_path)))
    got = {r["path"].rsplit("/", 1)[1]: (r["text"], r["error"] is not None) for r in rows.collect()}
    assert got == {"a.md": ("hello\nworld", False), "b.txt": ("", False), "d.pptx": ("slide & 2\n\nslide & 10", False), "e.docx": ("", True)}


def test_arriving_files_count_once(spark, tmp_path):
    for i, t in enumerate(("same", "same", "other")):
        (tmp_path / f"{i}.txt").write_text(t)
    q = streams.arriving(spark, str(tmp_path)).writeStream.format("memory").queryName("came").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("came").count() == 2


def test_pages_and_jobs(spark):
    pages = spark.createDataFrame([("d", i, "x" * 30, i == 2) for i in range(1, 7)], "document_id string, page_number int, text string, has_image boolean")
    now, later = files.pages_and_jobs(pages, 2)
    assert (now.count(), later.count(), now.filter("needs_recognition").count()) == (2, 4, 1)
