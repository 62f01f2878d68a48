import hashlib
import random

from pyspark.sql import functions as F

from tessera.llm import chat, pii, url_filter

from ._brute import base_spans, redacted


def hard_texts():
    rng = random.Random(3)
    alphabet = list("aZ9.@+-% 012345(),é\n_") + ["4111111111111111", "1.2.3.4", "a@b.cd", "+1 (555) 123-4567", "💡"]
    return ["", None, "a@b.c_x@y.com", "a@b.c@d.e", "4111 1111 1111 1111", "1.2.3.4.5.6.7.8", "00255.0.0.1",
            "999.1.1.1.2.3.4.5", "+1 1", "+12 345 678 9 ", "1.1.1.1 " * 1500, "9" * 60000, "a" * 60000,
            "1-" * 30000, "a." * 30000 + "@b", "+" + "(" * 5000] + [
        "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(800)]


def test_base_spans_match_brute_force(spark):
    texts = hard_texts()
    df = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)], "doc_id long, text string, found string")
    got = {r.doc_id: r.found for r in pii.find_spans(df.repartition(8)).collect()}
    for i, t in enumerate(texts):
        if t and len(t) > 20000 and "@" in t:
            continue  # the plain pattern takes quadratic time here
        found = [(k, s.start, s.end) for k in pii.BASE_KINDS for s in got[i][k]]
        assert found == base_spans(t if t is None or len(t) < 20000 else t), repr((t or "")[:60])
        for k in pii.KINDS:
            assert all(t[s.start:s.end] == s.value for s in got[i][k])


def test_query_names_all_spans(spark, tmp_path):
    """The digest of the base spans and the list of all of them, read from a table."""
    from tessera.llm.queries import QUERIES
    texts = hard_texts()[:200] + ["IBAN DE89 3704 0044 0532 0130 00, mail a@b.co, ip 10.0.0.1"]
    texts = [t for t in texts if t is None or len(t) < 20000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in QUERIES["op2_pii"](spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        base = base_spans(t)
        named = [f"{k}:{a}:{b}" for k, a, b in base]
        assert got[i].base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(got[i].spans.split(","))
        for k in pii.BASE_KINDS:
            assert got[i][f"n_{k}"] == sum(x[0] == k for x in base)
    last = got[len(texts) - 1].spans.split(",")
    assert any(x.startswith("iban:5:") for x in last) and len(last) == 3


def test_added_kinds_need_checksum_or_context(spark):
    df = spark.createDataFrame([
        (0, "DE89 3704 0044 0532 0130 00"), (1, "DE88 3704 0044 0532 0130 00"), (2, "GB82WEST12345698765432 x"),
        (3, "ssn 123-45-6789"), (4, "part 123-45-6789"), (5, "ssn 000-45-6789"), (6, "call 4111111111111111 card")],
        "doc_id long, text string")
    got = {r.doc_id: r.found for r in pii.find_spans(df).collect()}
    assert [len(got[i].iban) for i in range(3)] == [1, 0, 1]
    assert [len(got[i].ssn) for i in (3, 4, 5)] == [1, 0, 0]
    assert got[6].card[0].score == 100


def test_iban_ends_at_its_country_length(spark):
    de, gb, no = "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "NO93 8601 1117 947"
    cases = [(f"{de} BIC COBADEFFXXX", [de]), (f"{gb} The bank", [gb]),
             ("DE89370400440532013000 2024-01-02", ["DE89370400440532013000"]), (f"{de} {gb}", [de, gb]),
             (f"{no} {no}\n{gb} {de} 12 EUR", [no, no, gb, de]), (f"a {no} A {de}.", [no, de]),
             ("DE88 3704 0044 0532 0130 00 BIC", []), (f"{de[:-1]} x", []), ("DE89 " * 300, []),
             (f"{de} " * 200, [de] * 200)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.found.iban for r in pii.find_spans(df).collect()}
    clean = {r.doc_id: r.text for r in pii.redact_documents(df).collect()}
    for i, (text, want) in enumerate(cases):
        assert [s.value for s in got[i]] == want and all(text[s.start:s.end] == s.value for s in got[i])
        assert clean[i].count("<IBAN>") == len(want)


def test_redaction(spark):
    texts = [t for t in hard_texts() if t is None or len(t) < 20000]
    df = spark.createDataFrame([(i, t, "m", -1) for i, t in enumerate(texts)],
                               "doc_id long, text string, m string, n_chars int")
    out = pii.redact_documents(df)
    assert out.dtypes == df.dtypes
    for r in out.collect():
        t = texts[r.doc_id]
        assert r.m == "m"
        if t is None:
            assert r.text is None and r.n_chars == -1
        elif "<IBAN>" not in r.text and "<SSN>" not in r.text:
            assert r.text == redacted(t) and r.n_chars == len(r.text)


def test_no_python_in_native_plans(spark):
    docs = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    plan = pii.find_spans(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert pii.find_spans(docs.where("false")).count() == 0
    assert pii.redact_documents(docs.where("false")).count() == 0


EVENTS = "conv_id long, seq long, turn long, kind string, role string, payload string"


def fold(events):
    """Final messages of one conversation, one event after the other."""
    turns = {}
    for _, seq, turn, kind, role, payload in sorted(set(events), key=lambda e: e[1]):
        if kind in ("edit", "regenerate"):
            for t in [t for t in turns if t > turn]:
                del turns[t]
        now = turns.setdefault(turn, ["", ""])
        if kind == "start":
            now[0] = role or ""
        elif kind == "delta":
            now[1] += payload or ""
        else:
            now[1] = (payload or "") if kind == "edit" else ""
    return {t: tuple(x) for t, x in turns.items()}


def test_events_fold_like_a_replay(spark):
    rng, rows = random.Random(7), []
    for conv in range(40):
        seq = 0
        for _ in range(rng.randint(1, 40)):
            seq += 1
            turn = rng.randint(0, 4)
            kind = rng.choice(["start", "delta", "delta", "delta", "edit", "regenerate"])
            rows.append((conv, seq, turn, kind, rng.choice(["user", "assistant", None]) if kind == "start" else None,
                         rng.choice(["a", "é ", "</s>", None]) if kind in ("delta", "edit") else None))
    df = spark.createDataFrame(rows + rows[::3], EVENTS).repartition(6)
    got = {}
    for r in chat.final_messages(df).collect():
        got.setdefault(r.conv_id, {})[r.turn] = (r.role, r.text)
    for conv in range(40):
        assert got.get(conv, {}) == fold([r for r in rows if r[0] == conv]), conv


def test_rendering_is_reversible(spark):
    rng = random.Random(8)
    parts = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "[", "/", "s>", " ok ", "\n", "é", "💡", "INST]", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", None, "[/INST]", "a\\</s>"]),
             "".join(rng.choice(parts) for _ in range(rng.randint(0, 9))) if rng.random() < .9 else None)
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "no id"), (5, 0, "user", "tie"), (5, 0, "user", "tie")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    rendered = chat.render(chat.final_messages(chat.events_of(df)))
    back = rendered.select("conv_id", "segments", "formatted", chat.read_back(F.col("formatted")).alias("turns"))
    got = {r.conv_id: r for r in back.collect()}
    digest = {r.conv_id: r for r in chat.digests(rendered).collect()}
    for c in {r[0] for r in rows}:
        want = sorted((t, role or "", text or "") for k, t, role, text in rows if k == c)
        assert [(x.role, x.text) for x in got[c].turns] == [w[1:] for w in want]
        assert "".join(s.text for s in got[c].segments) == got[c].formatted
        assert got[c].formatted.count("</s>") == len(want) == digest[c].n_turns
        loss = "".join(text for _, role, text in want if role == "assistant")
        assert digest[c].loss_chars == len(loss)
        assert digest[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        said = "".join(f"{role}\n{text}\n" for _, role, text in want)
        assert digest[c].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert digest[c].formatted_chars == len(got[c].formatted)
    empty = df.where("false")
    assert chat.digests(chat.render(chat.final_messages(chat.events_of(empty)))).count() == 0


LOG = "list string, policy string, pattern string, change string, changed_at timestamp"
CAPTURES = "capture_id long, url string, fetched_at timestamp"


def active(log, pattern, at):
    """(list, policy, since) active for a pattern: a replay of the log."""
    out = []
    for key in {(r[0], r[1]) for r in log if r[2] == pattern}:
        since = None
        for t in sorted({r[4] for r in log if (r[0], r[1]) == key and r[2] == pattern and r[4]}):
            if t > at:
                break
            off = any(r[3] == "remove" for r in log if (r[0], r[1]) == key and r[2] == pattern and r[4] == t)
            since = None if off else (since or t)
        if since:
            out.append((*key, since))
    return out


def keys(url):
    host = url.split("://")[1].split("/")[0].split("?")[0].split("#")[0].split("@")[-1].split(":")[0].lower().rstrip(".")
    path = (url.split("://")[1] + "/").split("/", 1)[1].split("?")[0].split("#")[0].strip("/")
    parts, seg = host.split("."), [s for s in path.split("/") if s]
    return {".".join(parts[i:]) for i in range(len(parts))} | {
        host + "/" + "/".join(seg[:i]) for i in range(1, len(seg) + 1)}


def test_captures_see_the_lists_of_their_time(spark):
    import datetime as dt
    rng, start = random.Random(11), dt.datetime(2024, 3, 1)

    def when():
        return start + dt.timedelta(hours=rng.randint(0, 200))

    hosts = ["a.example.com", "b.example.com", "example.org", "A.Example.com."]
    patterns = ["example.com", "a.example.com", "com", "a.example.com/x", "a.example.com/x/y", "b.example.com/z", "org"]
    log = [(f"l{rng.randint(0, 2)}", rng.choice(["block", "block", "allow"]), rng.choice(patterns),
            rng.choice(["add", "add", "remove"]), when()) for _ in range(400)]
    log += [("l0", "block", "example.com", "add", None), ("l0", "block", None, "add", start)]
    caps = [(i, f"https://{rng.choice(hosts)}/{rng.choice(['', 'x', 'x/y/q', 'z?k=/x', 'x#/y'])}", when())
            for i in range(300)]
    caps += [(1000, None, start), (1001, "not a url", start), (1002, "http://a.example.com", None), caps[0]]
    got = {}
    for r in url_filter.evaluate(spark.createDataFrame(caps, CAPTURES), spark.createDataFrame(log, LOG)).collect():
        got.setdefault(r.capture_id, []).append(r)
    assert sum(map(len, got.values())) == len(caps)
    for i, url, at in caps:
        hits = []
        if url and "://" in url and at:
            hits = [(len(k), policy == "allow", k, name, since) for k in keys(url)
                    for name, policy, since in active(log, k, at)]
        for r in got[i]:
            assert r.n_active == len(hits)
            if not hits:
                assert r.verdict == "none" and r.pattern is None
            else:
                best = max(hits)
                assert (r.verdict == "allow") == best[1] and (r.pattern, r.list, r.since) == best[2:]


def test_no_lists_match_nothing(spark):
    caps = spark.createDataFrame([(1, "http://a.b/c", None)], CAPTURES)
    log = spark.createDataFrame([], LOG)
    assert [r.verdict for r in url_filter.evaluate(caps, log).collect()] == ["none"]
    assert url_filter.evaluate(caps.where("false"), log).count() == 0
    assert url_filter.allowed(caps, log).count() == 1
