import http.server
import json
import sys
import threading
import types

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone import catalog
from lodestone.config import Config, JudgeConfig
from lodestone.functions import jsonfix
from lodestone.operators import judge as judges
from lodestone.operators.rubric import Rubric
from lodestone.plans import ranker
from lodestone.sources import ingest, ocr, report
from lodestone.streaming import scorer

SF = "/root/testdata/sf0.001"
RUBRIC = Rubric({"title": "t", "education_relevant_fields": ["Finance"], "categories": [{"name": "A", "weight": 60, "must_have": True, "skills": ["alpha tool", "zq"]}, {"name": "B", "weight": 40, "skills": ["betagamma"]}]})


@pytest.mark.parametrize(
    ("reply", "score", "error"),
    [
        ('{"score": 120}', 100, None), ('{"score": "82"}', 82, None), ('{"score": "82.5"}', None, "no 'score' field in model output"), ('```json\n{"score": 5,}\n```', 5, None), ('ok {"score": 7, "gaps": None} bye', 7, None),
        ("[1,2]", None, "unexpected JSON type"), ("what", None, "could not parse JSON"), (None, None, "could not parse JSON"), ('{“score”: 9 // sure\n}', 9, None),
    ],
)
def test_replies(spark, reply, score, error):
    j = spark.createDataFrame([(reply,)], "r string").select(jsonfix.judged(F.col("r")).alias("j")).first().j
    assert (j.score, j.error) == (score, error)


def test_reply_fields(spark):
    reply = json.dumps({"score": 50, "confidence": 3, "years_relevant": 2.5, "seniority": "x" * 50, "strengths": ["a", " ", *"bcdefg"], "gaps": "one", "reasoning": " r ", "recommendation": "Strong_Fit"})
    j = spark.createDataFrame([(reply,)], "r string").select(jsonfix.judged(F.col("r")).alias("j")).first().j
    assert (j.confidence, j.years_relevant, len(j.seniority), j.strengths, j.gaps, j.reasoning, j.recommendation) == (1.0, 2.5, 32, list("abcde"), ["one"], "r", "strong_fit")


def test_each_document_is_judged_once(spark, tmp_path):
    """What needs the replies, the order, the firsts of equal texts and the rows themselves, must not ask again; rows of one id stay apart."""
    log = str(tmp_path / "calls")

    def ask(prompt, system, context, tokens):
        with open(log, "a") as file:
            file.write("x")
        return judges.stand_in(prompt, system, context, tokens)

    texts = [(1, "alpha tool"), (2, "betagamma"), (2, "alpha tool and betagamma"), (3, ""), (None, "neither of them")]
    rows = ranker.rank(spark.createDataFrame(texts, "doc_id long, text string"), RUBRIC, "role", Config(), ask).collect()
    assert sorted(r["rank"] for r in rows) == [1, 2, 3, 4, 5]
    assert sorted((r.doc_id or 0, r.judge_score is not None) for r in rows) == [(0, True), (1, True), (2, True), (2, True), (3, False)]
    assert len(open(log).read()) == 4


def test_judge_routes_and_retries():
    calls = []

    def ask(prompt, system, context, tokens):
        calls.append((context, tokens))
        return judges.stand_in(prompt, system, context, tokens)

    reply, error, n = judges.judge_one(ask, "role", RUBRIC, ["short"], [], [])
    assert error is None and n == 1 and calls == [(8192, 420)] and json.loads(reply)["score"] >= 0
    calls.clear()
    reply, error, n = judges.judge_one(ask, "role", RUBRIC, ["x" * 6000, "y" * 6000], [], [])
    assert error is None and n == 3 and [c for c, _ in calls] == [4096, 4096, 8192]

    tries = []

    def broken(*a):
        tries.append(a)
        raise OSError("down")

    reply, error, n = judges.judge_one(broken, "role", RUBRIC, ["short"], [], [], JudgeConfig(), wait=lambda s: None)
    assert reply is None and error == "OSError: down" and len(tries) == 6

    answers = iter(["prose only", '{"score": 1}'])
    assert judges.judge_one(lambda *a: next(answers), "role", RUBRIC, ["short"], [], [])[0] == '{"score": 1}'


def ranked(spark, ask=None):
    docs = spark.createDataFrame(
        [
            (1, "a.txt", "Karen Brown\nalpha tool and betagamma, 2010-2015\nkaren@firm.io +1 555-010-9999", "s1", None),
            (2, "b.txt", "Karen Brown\nalpha tool and betagamma, 2010-2015\nkaren@firm.io +1 555-010-9999", "s1", None),
            (3, "c.txt", "  ", "", None), (4, "d.txt", None, "", "bad file"), (5, "e.txt", "zq", "s5", "bad page"),
        ],
        "doc_id long, file string, text string, sha1 string, error string",
    )
    return {r.doc_id: r for r in ranker.rank(docs, RUBRIC, "role", Config(), ask).collect()}


def test_ranking_without_a_judge(spark):
    rows = ranked(spark)
    assert sorted(r["rank"] for r in rows.values()) == [1, 2, 3, 4, 5]
    assert rows[1]["rank"] == 1 and rows[2]["rank"] == 2 and "duplicate-of:a.txt" in rows[2].warnings and rows[1].duplicate_of is None
    assert rows[3].parse_status == "empty" and rows[3].final_score == 0 and rows[3].warnings == ["no-text-extracted"] and rows[3].recommendation == "weak_fit"
    assert rows[4].parse_status == "empty" and rows[4].warnings == ["extract:bad file", "no-text-extracted"]
    assert rows[5].parse_status == "error" and rows[5].final_score > 0
    assert rows[1].name == "Karen Brown" and rows[1].email == "karen@firm.io" and rows[1].years_experience == 5.0 and rows[1].blend == "deterministic-only"
    assert rows[1].evidence[0].startswith("A: alpha tool — “") or rows[1].evidence[0].startswith("B: betagamma")


def test_ranking_with_a_judge(spark):
    rows = ranked(spark, judges.stand_in)
    assert rows[1].judge_score is not None and rows[1].blend.startswith("blend 0.4*")
    assert rows[3].judge_score is None and rows[5].judge_score is None
    assert rows[1].final_score == pytest.approx(round(0.4 * rows[1].keyword_exact + 0.6 * rows[1].judge_score, 2), abs=0.011)

    def broken(*a):
        raise RuntimeError("no")

    rows = ranked(spark, broken)
    assert rows[1].parse_status == "llm-failed" and any(w.startswith("llm:RuntimeError") for w in rows[1].warnings)


def test_files_cache_and_reports(spark, tmp_path):
    folder = tmp_path / "in" / "sub"
    folder.mkdir(parents=True)
    (folder / "10.txt").write_text("alpha tool\fpage two")
    (folder.parent / "2.txt").write_text("zq")
    (folder.parent / "3.txt").write_text("zq")
    files = ingest.discover(spark, str(tmp_path / "in"), "*.txt")
    assert [r.file for r in files.orderBy("input_pos").collect()] == ["2.txt", "3.txt", "10.txt"]
    assert ingest.discover(spark, str(tmp_path / "in"), "*.txt", limit=1).count() == 1
    docs = ingest.extracted(files)
    ten = docs.where("file = '10.txt'").first()
    assert ten.pages == 2 and ten.text == "alpha tool\npage two" and ten.error is None
    ingest.to_cache(docs, str(tmp_path / "cache"))
    again = ingest.with_cache(files, spark.read.parquet(str(tmp_path / "cache")), lambda content: 1 / 0)
    assert again.where("cached").count() == 3
    assert ingest.extracted(files, lambda content: 1 / 0).where("error = 'division by zero'").count() == 3
    out = ranker.rank(docs.withColumn("doc_id", F.col("input_pos").cast("long")), RUBRIC).cache()
    report.write_csv(out, str(tmp_path / "csv"), top=2)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 2
    report.write_csv_file(out, str(tmp_path / "top.csv"), 2)
    assert (tmp_path / "top.csv").read_bytes().startswith(b"\xef\xbb\xbfRank,File,Candidate")
    report.write_json(out, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    assert "<table>" in report.html_page(out, 2, "<b>") and "&lt;b&gt;" in report.html_page(out, 2, "<b>")
    assert "3 documents" in report.console(out)
    assert {r.kind for r in ingest.audit(docs, least=5).collect()} == {"text", "scan"}


def test_rendering():
    assert [ocr.render_side(gb) for gb in (1, 2, 4, 6, 8, 9, 64)] == [1100, 1100, 1400, 1700, 1700, 2000, 2000]
    assert ocr.render_dpi(10.0, 1100) == 400 and ocr.render_dpi(0, 2000) == 200 and ocr.render_dpi(792, 1700) == 154
    assert ocr.render_dpi(400, 1000) == 200 and ocr.render_dpi(792, 1100) == 100  # raised within the budget; not beyond it


def test_first_backend_that_can_be_had(monkeypatch):
    calls = []

    def broken():
        calls.append("a")
        raise ImportError("a")

    monkeypatch.setattr(ocr, "BACKENDS", {"a": broken, "b": lambda: lambda image: image.decode()})
    assert ocr.reader(("a", "b"))(b"page") == "page" and calls == ["a"] and ocr.reader(("a",)) is None


def test_pdf_pages(monkeypatch):
    """A stand-in for the library: a page with a text layer, one without, and one that breaks."""

    class Page:
        def __init__(self, text):
            self.text, self.rect = text, types.SimpleNamespace(width=612, height=792)

        def get_text(self):
            if self.text is None:
                raise ValueError("bad page")
            return self.text

        def get_pixmap(self, dpi):
            return types.SimpleNamespace(tobytes=lambda kind: f"{kind} at {dpi}".encode())

    class Document(list):
        needs_pass = False
        __enter__ = lambda self: self
        __exit__ = lambda self, *a: None

    doc = Document([Page("x" * 200), Page("sparse"), Page(None)])
    monkeypatch.setitem(sys.modules, "pymupdf", types.SimpleNamespace(open=lambda **k: doc))
    read = lambda image: image.decode()
    assert ingest.pdf_text(b"", read) == [("x" * 200, False), ("png at 154", True), ("", False)]
    assert ingest.pdf_text(b"", read, always=True) == [("png at 154", True)] * 3
    assert ingest.pdf_text(b"") == [("x" * 200, False), ("", False), ("", False)]
    doc.needs_pass = True
    with pytest.raises(PermissionError):
        ingest.pdf_text(b"", read)


def test_judge_is_routed_by_its_health(spark):
    assert judges.routed(judges.stand_in, lambda: "ok") is judges.stand_in and judges.routed(judges.stand_in, None) is judges.stand_in
    assert judges.routed(judges.stand_in, lambda: "unreachable") is None and judges.routed(None, lambda: 1 / 0) is None
    docs = spark.createDataFrame([(1, "alpha tool")], "doc_id long, text string")
    row = ranker.rank(docs, RUBRIC, "role", Config(), judges.stand_in, health=lambda: "unreachable").first()
    assert row.judge_score is None and row.blend == "deterministic-only"
    with pytest.raises(LookupError):
        ranker.rank(docs, RUBRIC, "role", Config(), judges.stand_in, health=lambda: "model-missing")


def test_health_probe_and_warm_up():
    class Tags(http.server.BaseHTTPRequestHandler):
        def do_GET(self):
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"models": [{"name": "small:7b"}]}).encode())

        def log_message(self, *a):
            pass

    server = http.server.HTTPServer(("127.0.0.1", 0), Tags)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/tags"
    assert judges.healthy(url, "small") == "ok" and judges.healthy(url, "large") == "model-missing"
    assert judges.check(url, "large")[0] is False
    ok, said = judges.check(url, "small:7b", judges.stand_in)
    assert ok and len(said) == 2 and "documents a minute" in said[1]
    server.shutdown()
    server.server_close()
    assert judges.healthy(url, "small") == "unreachable" and judges.check(url, "small")[0] is False
    assert judges.warm(judges.stand_in) and not judges.warm(lambda *a: 1 / 0)


def test_calls_are_under_way_together(spark):
    """Four rows in one task, each call waiting for the others."""
    gate = "lodestone_gate"

    def ask(prompt, system, context, tokens):
        barrier = sys.modules.setdefault(gate, threading.Barrier(4))
        barrier.wait(timeout=30)
        return judges.stand_in(prompt, system, context, tokens)

    rows = spark.range(4).selectExpr("id AS doc_id", "array(named_struct('text', concat('t', id))) AS chunks", "array('a') AS matched", "array('b') AS missing")
    found = judges.judge(rows, "doc_id", RUBRIC, "role", ask, JudgeConfig(partitions=1, at_once=4, attempts=1)).collect()
    assert sorted(r.doc_id for r in found) == [0, 1, 2, 3] and all(r.judge.error is None and r.calls == 1 for r in found)


def test_streaming_scores_each_file_once(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha tool"), (2, "none")], "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        scorer.follow(spark, str(tmp_path / "in"), docs.schema, RUBRIC, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    rows = {r.doc_id: r.score for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert len(rows) == 2 and rows[1] > rows[2] == 0


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) else v


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n in catalog.ORACLES])
def test_queries_equal_their_sql(spark, tables, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    cur = tables.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in cur.fetchall()), key=str)
    assert got == want
