"""Secret scan: spans, redaction, forest, odd rows."""

import random
import re

from tripgraph.llm import secret_forest as S
from tripgraph.llm.queries import op1_secret_forest

from . import brute


def test_query_finds_assigned_tokens(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{brute.SF}/documents.parquet").collect()}
    rows = op1_secret_forest(spark, brute.SF).collect()
    candidate = re.compile(S.CANDIDATE)
    assert len(rows) == sum(len(candidate.findall(t)) for t in texts.values())
    planted = {(i, m.start(1)) for i, t in texts.items() for m in re.finditer(r'(?i)token = "([0-9a-f]{40})"', t)}
    assert planted and planted == {(r.doc_id, r.start) for r in rows if r.secret}


def docs(spark):
    hexes = [f"{(k * 0x9E3779B97F4A7C15F39CC0605CEDC8341082276BF3A27251) % 16**40:040x}" for k in range(1, 40)]
    rows = [(k, f'set token = "{h}" here', "s") for k, h in enumerate(hexes)]
    rows += [(100 + k, f"order number 49359529{k:08d} was sent", "s") for k in range(40)]
    rows += [(200, None, "s"), (201, "", "s"), (202, "no digits at all", "s"), (None, f"password: {hexes[0]}!", "s"), (1, rows[1][1], "s")]
    rows += [(203, " ".join(f'token = "{h}" 493595293590025{k}' for k, h in enumerate(hexes[:5])), "s"), (204, "9" * 5000, "s")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, found string").repartition(3), hexes


def test_odd_rows_and_redaction(spark):
    df, hexes = docs(spark)
    rows = S.scan(df).collect()
    of = {}
    for r in rows:
        of.setdefault(r.doc_id, []).append(r)
    assert not {200, 201, 202} & set(of)
    assert len(of[1]) == 2 and all(r.secret for r in of[1]) and of[None][0].secret
    assert not any(r.secret for k in range(100, 140) for r in of[k])
    assert [r.secret for r in sorted(of[203], key=lambda r: r.finding_no)] == [True, False] * 5
    trees, words, _ = S.train(df)
    red = S.redact(df, trees, words)
    assert red.columns == df.columns
    got = {(r.doc_id, r.text) for r in red.collect()}
    assert (200, None) in got and (201, "") in got and (202, "no digits at all") in got
    assert (0, f'set token = "{S.REDACTED}" here') in got and (None, f"password: {S.REDACTED}!") in got
    text = next(t for i, t in got if i == 203)
    assert text.count(S.REDACTED) == 5 and not any(h in text for h in hexes) and text.count("493595293590025") == 5


def test_whole_runs_and_assigned_values_are_candidates(spark):
    key = "".join(f"{(k * 0x9E3779B97F4A7C15) % 16**16:016x}" for k in range(1, 76))  # 1,200 characters
    letters = "QwErTyUiOpAsDfGhJkLzXcVbNm"
    texts = [f"x {key} y", f"see {letters} there", 'password = "hunter2x9"', "pwd: p@ss!w0rd.", f"'secret' => '{letters}'", "api_key=abc&user=bob",
             'password = "', "token = == x", 'token: "two words"', "author: nobody", f'"token":"{key}"', "the password is short", "auth:\n" + "z" * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: (r.value, texts[r.doc_id].index(r.value) == r.start) for r in S.findings(df, []).collect()}
    want = {0: key, 1: letters, 2: "hunter2x9", 3: "p@ss!w0rd", 4: letters, 5: "abc", 8: "two words", 10: key, 12: "z" * 9}
    assert got == {i: (v, True) for i, v in want.items()}


def test_values_of_longer_names_addresses_headers_and_dotted_tokens(spark):
    dotted = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r"
    wanted = [('db_password_prod = "p@ss!w0rd"', "p@ss!w0rd"), ("PASSWORD_HASH_KEY=s3cr3t!x", "s3cr3t!x"), ("client.secret.value: q9!w8@e7#r6$a", "q9!w8@e7#r6$a"),
              ("tokenValue: abc12", "abc12"), ("open postgres://admin:hunter2xyz@db.host/x now", "hunter2xyz"), ("Authorization: Bearer abc.def.ghi12345", "abc.def.ghi12345"),
              (f"see {dotted} there", dotted), ("mark \ufdd0 password=hunter2 \ufdd0", "hunter2")]
    none = ["author: nobody", "AUTHOR: Nobody", "see http://host:8080/x", "mail me@host.org", "the token was lost"]
    df = spark.createDataFrame(list(enumerate([t for t, _ in wanted] + none)), "doc_id bigint, text string")
    rows = S.findings(df, []).collect()
    for k, (text, value) in enumerate(wanted):
        assert (value, text.index(value), 0.0 if value == dotted else 2.0) in {(r.value, r.start, r.secret_word) for r in rows if r.doc_id == k}, text
    assert not [r for r in rows if r.doc_id >= len(wanted)]


def test_texts_are_searched_once(spark, capsys):
    df, _ = docs(spark)
    S.findings(df, []).explain("simple")
    assert capsys.readouterr().out.count("regexp_replace(coalesce(text") == 1


def test_leaves_weigh_labels_by_their_full_counts(spark, monkeypatch):
    """A feature value that a fifth of its findings share with secrets: not a secret, however few train."""
    rows = [(k, f"x {'Q' * 16 if k % 10 < 5 else 'q' * 16} y") for k in range(400)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    label = lambda f: f.selectExpr("*", "CAST(value RLIKE 'Q' AND doc_id % 10 = 0 AS INT) AS label")
    for cap in (10_000, 30):
        monkeypatch.setattr(S, "TRAIN_FINDINGS", cap)
        got = {r.value: r.score for r in S.scan(df, label=label).collect()}
        # Trees that draw no telling feature keep the share of secrets in all findings, 0.1.
        assert abs(got["Q" * 16] - 0.2) < 0.12 and got["q" * 16] < 0.1


def test_long_short_and_digitless_secrets_are_redacted_whole(spark):
    rnd = random.Random(4)
    values = ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz", 9 + k % 9)) for k in range(60)]
    values += ["".join(rnd.sample("abcdefghijklmnopqrstuvwxyz0123456789", 9)) for _ in range(60)]
    long = "".join(f"{(k * 0x9E3779B97F4A7C15) % 16**16:016x}" for k in range(1, 76))
    rows = [(k, f'password = "{v}" and more') for k, v in enumerate(values)] + [(500 + k, f"order number 49359529{k:08d} was sent") for k in range(120)]
    rows += [(900 + k, f'token = "{long[k:]}" end') for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    trees, words, _ = S.train(df)
    got = {r.doc_id: r.text for r in S.redact(df, trees, words).collect()}
    assert all(got[900 + k] == f'token = "{S.REDACTED}" end' for k in range(40))
    assert sum(got[k] == f'password = "{S.REDACTED}" and more' for k in range(len(values))) == len(values)
    assert all(got[k] == t for k, t in rows if 500 <= k < 900)


def test_without_both_labels_nothing_is_a_secret(spark):
    df = spark.createDataFrame([(1, "order 4935952935900253")], "doc_id bigint, text string")
    assert [(r.score, r.secret) for r in S.scan(df).collect()] == [(0.0, False)]
    assert S.scan(df.limit(0)).collect() == []


def test_forest_learns_given_labels(spark):
    """Labels that no rule here gives: values with capitals are the secrets."""
    rows = [(k, f"x {'ABCD' if k % 2 else 'abcd'}{k:014d} y") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = S.scan(df, label=lambda f: f.selectExpr("*", "CAST(value RLIKE '[A-Z]' AS INT) AS label")).collect()
    assert all(r.secret == r.value.startswith("ABCD") for r in got)


def test_main_path_is_native(spark, capsys):
    df, _ = docs(spark)
    S.redact(df, *S.train(df)[:2]).explain("extended")
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
