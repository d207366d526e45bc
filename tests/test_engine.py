import base64
import hashlib
import hmac
import json
import threading
import urllib.error
import urllib.request

import pytest
from pyspark.sql import functions as F

from sparkloom import cli, config, resilience, server
from sparkloom.engine import Agent, KnowledgeBase
from sparkloom.errors import AccessDenied, ConfigError, IngestError, MissingDependency, ProviderError
from sparkloom.functions.guards import Guardrails
from sparkloom.operators.store import VersionedTable, cached_apply, write_cache
from sparkloom.registry import Registry, registry
from sparkloom.sources import loaders


def test_registry():
    r = Registry()

    @r.register("llm", "echo")
    def echo(times: int, word: str = "x", tags: list | None = None, cache=None):
        return [word * times, cache]

    assert r.create("llm", "echo", {"times": 2}, cache="c", spark="s") == ["xx", "c"] and r.names("llm") == ["echo"]
    assert r.settings_schema("llm", "echo") == {"type": "object", "properties": {"times": {"type": "integer"}, "word": {"type": "string", "default": "x"}, "tags": {"type": "array", "default": None}}, "additionalProperties": False, "required": ["times"]}
    for bad in ({}, {"times": "2"}, {"times": True}, {"times": 1, "other": 2}):
        with pytest.raises(ConfigError):
            r.create("llm", "echo", bad)
    with pytest.raises(ConfigError):
        r.register("nope", "x")(echo)
    r.register_lazy("llm", "gone", "no_such_module_here:X", "some-extra")
    with pytest.raises(MissingDependency, match="some-extra"):
        r.create("llm", "gone")
    assert registry.create("chunker", "fixed", {"size": 10, "overlap": 2}).keywords["size"] == 10


def test_settings(tmp_path):
    assert config.deep_merge({"a": {"provider": "x", "k": 1}, "b": {"c": 1}}, {"a": {"provider": "y"}, "b": {"d": 2}}) == {"a": {"provider": "y"}, "b": {"c": 1, "d": 2}}
    assert config.resolve({"preset": "cheap"})["chunker"]["size"] == 800
    for bad in ({"preset": "no"}, {"other": 1}, {"llm": {"provider": "x", "api_key": "k"}}):
        with pytest.raises(ConfigError):
            config.resolve(bad)
    (tmp_path / "c.toml").write_text('sources = ["docs"]\nk = 2\n')
    got = config.load_config(str(tmp_path / "c.toml"))
    assert got["sources"] == [str(tmp_path / "docs")] and got["k"] == 2 and got["index"].startswith(str(tmp_path))
    (tmp_path / ".env").write_text("﻿# c\nexport A=1 # x\nB=\"a\\n#b\"\nC='a # b'\nD=x#y\nnot a line\n")
    have = {"D": "kept"}
    assert config.load_env(str(tmp_path / ".env"), have) == ["A", "B", "C"] and have == {"A": "1", "B": "a\n#b", "C": "a # b", "D": "kept"}


def test_failing_models():
    class Busy(Exception):
        status = 429

    calls, slept = [], []

    def model(prompts):
        calls.append(prompts)
        if len(calls) < 3:
            raise Busy
        return [p.upper() for p in prompts]

    from sparkloom.plugins import MemoryCache

    m = resilience.Resilient([model], MemoryCache(), sleep=slept.append, budget=resilience.Budget(calls=2))
    assert m(["a"]) == ["A"] and len(slept) == 2 and m(["a"]) == ["A"] and m.cache_hits == 1 and len(calls) == 3
    assert m(["b"]) == ["B"]
    with pytest.raises(resilience.BudgetExceeded):
        m(["c"])

    def broken(prompts):
        raise ValueError("no")

    assert resilience.Resilient([broken, lambda p: ["second"] * len(p)])(["x"]) == ["second"]
    with pytest.raises(ProviderError):
        resilience.Resilient([broken])(["x"])
    now = [0.0]
    limiter = resilience.RateLimiter(60, lambda: now[0], lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        limiter.wait()
    assert now[0] == 3.0 and resilience.wait_before(9) <= 60 and resilience.wait_before(0, 500) == 120
    assert resilience.Lazy(lambda: lambda p: p)(["q"]) == ["q"]


@pytest.fixture
def home(tmp_path):
    docs = tmp_path / "docs"
    (docs / "hr").mkdir(parents=True)
    (docs / "hr" / "leave.md").write_text("# Leave\n\nAnnual leave is 25 days a year.\n")
    (docs / "it.md").write_text("# Network\n\nThe office network needs a token.\n")
    (docs / "pic.xyz").write_text("?")
    (tmp_path / "c.json").write_text(json.dumps({"sources": ["docs"], "index": "index", "k": 1, "retriever": {"provider": "sparse"}, "evaluation": {"thresholds": {"hit": 0.5}}}))
    return tmp_path


def test_knowledge_base_and_command_line(spark, home, capsys):
    kb = KnowledgeBase(spark, config.load_config(str(home / "c.json")))
    states, warnings = kb.ingest()
    assert {(r.rel, r.state) for r in states.collect()} == {("hr/leave.md", "new"), ("it.md", "new")} and warnings.count() == 1 and kb.count() == 2
    (home / "docs" / "it.md").write_text("# Network\n\nThe office network needs a badge.\n")
    (home / "docs" / "hr" / "pay.md").write_text("# Pay\n\nSalaries come on the last day.\n")
    assert {(r.rel, r.state) for r in kb.ingest()[0].collect()} == {("hr/leave.md", "unchanged"), ("it.md", "changed"), ("hr/pay.md", "new")}
    assert {r.text for r in kb.chunks().where("rel = 'it.md'").collect()} == {"The office network needs a badge."} or kb.chunks().where("text like '%badge%'").count() == 1
    (home / "docs" / "hr" / "pay.md").unlink()
    assert ("hr/pay.md", "removed") in {(r.rel, r.state) for r in kb.ingest()[0].collect()} and kb.count() == 2
    x = Agent(kb).ask("How many days of annual leave?")
    assert "25 days" in x["answer"] and x["verified"] == 1
    (home / "set.jsonl").write_text(json.dumps({"question": "annual leave days", "gold_sources": [{"source": "leave.md", "quote": "25 days"}], "gold_answer": "25"}) + "\n")
    run = lambda *a: cli.main([*a], spark)
    assert run("eval", "run", str(home / "c.json"), str(home / "set.jsonl")) == 0 and "hit" in capsys.readouterr().out
    assert run("eval", "check", str(home / "c.json"), str(home / "set.jsonl")) == 0 and '"no_unanswerable": true' in capsys.readouterr().out
    assert run("presets") == 0 and run("ask", str(home / "none.json"), "x") == 2 and run("inspect", str(home / "c.json")) == 0


def test_server(spark, home):
    kb = KnowledgeBase(spark, config.load_config(str(home / "c.json")))
    kb.ingest()
    secret = b"s" * 32
    auth = server.TokenAuth(secret)
    with pytest.raises(ConfigError):
        server.make_server(Agent(kb), 0, "0.0.0.0")
    with pytest.raises(ConfigError):
        server.KeyAuth({"short": None})
    http = server.make_server(Agent(kb), 0, auth=auth)
    threading.Thread(target=http.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{http.server_port}"
    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()

    def token(exp):
        body = part({"alg": "HS256"}) + "." + part({"exp": exp, "roles": ["a"]})
        return body + "." + base64.urlsafe_b64encode(hmac.new(secret, body.encode(), hashlib.sha256).digest()).rstrip(b"=").decode()

    def post(path, body, exp=9e12):
        q = urllib.request.Request(url + path, json.dumps(body).encode(), {"Authorization": "Bearer " + token(exp)})
        try:
            with urllib.request.urlopen(q) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, None

    assert json.loads(urllib.request.urlopen(url + "/readyz").read()) == {"ready": True}
    assert post("/ask", {"question": "annual leave days"})[1]["abstained"] is False
    assert post("/ask", {"question": ""})[0] == 422 and post("/ask", {"question": "x"}, 1)[0] == 401 and post("/none", {})[0] == 404
    http.shutdown()
    with pytest.raises(AccessDenied):
        auth({"Authorization": "Bearer a.b"})


def test_sources_that_overlap_and_names_that_clash(spark, tmp_path):
    for folder in ("a", "b"):
        (tmp_path / folder).mkdir()
        (tmp_path / folder / "same.md").write_text(folder)
    rel = lambda *s: sorted(r.rel for r in loaders.discover(spark, list(s)).collect())
    assert rel(str(tmp_path / "a"), str(tmp_path / "b")) == ["b/same.md", "same.md"]
    assert rel(str(tmp_path / "a"), str(tmp_path / "a" / "same.md")) == ["same.md"]
    with pytest.raises(Exception, match="different settings"):
        rel(str(tmp_path / "a"), loaders.Source(str(tmp_path / "a" / "same.md"), metadata=(("k", "v"),)))
    with pytest.raises(IngestError):
        rel(str(tmp_path / "none"))


def test_versions_replacement_caches_and_allowed_data(spark, tmp_path):
    t = VersionedTable(spark, str(tmp_path / "t"), "id string, doc_id string", "doc_id", 8)
    rows = lambda *x: spark.createDataFrame(list(x), "id string, doc_id string")
    t.write(rows(("1", "a"), ("2", "a"), ("3", "b")))
    t.replace(rows(("4", "a")), rows(("", "b")).select("doc_id"))
    assert sorted(map(tuple, t.read().collect())) == [("4", "a")]
    before = t.version()
    with pytest.raises(IngestError):
        t._publish({}, {}, before - 1)
    t.vacuum(1)
    assert t.version() == before and t.read().count() == 1
    cache = VersionedTable(spark, str(tmp_path / "c"), "key string, value string, at timestamp", "key", 4)
    double = lambda df: df.withColumn("value", F.concat("x", "x"))
    asks = spark.createDataFrame([("a",), ("b",), ("a",)], "x string")
    out, misses = cached_apply(asks, cache.read(), "x", double)
    assert sorted(r.value for r in out.collect()) == ["aa", "aa", "bb"]
    write_cache(cache, misses)
    assert cached_apply(asks, cache.read(), "x", double, 3600)[1].count() == 0 and cached_apply(asks, cache.read(), "x", double, 0)[1].count() == 2
    g = Guardrails(kinds=("email",), injection=False, allow=["[a-z]+@ok\\.com"])
    df = spark.createDataFrame([("to a@ok.com and b@no.com",), ("a@ok.com",)], "t string").select(g.apply(F.col("t")).alias("g"))
    assert [tuple(r.g) for r in df.collect()] == [("redact", "pii", "to a@ok.com and [EMAIL]"), ("allow", None, "a@ok.com")]
