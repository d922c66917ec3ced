"""Conversation repair, personal data and periodic runs beside brute-force versions of their contracts."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from vesselspark.llm import conversation, periodic, pii, queries

SF = "/root/testdata/sf0.01"
sha = lambda text: hashlib.sha256(text.encode()).hexdigest()


# --- op11


def cheapest(codes):
    """(cost, audit) by trying every edit from every state of the grammar, the audit as a string."""
    after = {0: "u", 1: "u", 2: "a", 3: "u"}
    to = {"s": 1, "u": 2, "a": 3}

    def with_inserts(best):
        for _ in range(3):
            for state, (cost, audit) in list(best.items()):
                end, way = to[after[state]], (cost + 3, audit + "I")
                best[end] = min(best.get(end, way), way)
        return best

    best = with_inserts({0: (0, "")})
    for initial, forced, cut in codes:
        new = {}
        for state, (cost, audit) in best.items():
            ways = [(state, 4, "D")]
            if not forced:
                extra = 3 * cut
                ways.append((to[after[state]], extra + (0 if initial == after[state] else 3), "K" if initial == after[state] else "R"))
                if state == 0 and initial == "s":
                    ways.append((1, extra, "K"))
            for end, more, edit in ways:
                way = (cost + more, audit + edit)
                new[end] = min(new.get(end, way), way)
        best = with_inserts(new)
    return min(best[s] for s in (0, 3) if s in best)


def plain_repair(rows):
    """The whole contract over rows (conv_id, turn, role, text), damage included, and the repaired lines."""
    told = lambda x: " " if x is None else str(x)
    talks = {}
    for conv, turn, role, text in rows:
        own = talks.setdefault(conv, [])
        role, text = told(role), told(text)
        h = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        if h == 0:
            continue
        text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
        own += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    out = {}
    for conv, own in talks.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        counts, codes, seen = {"blank": 0, "duplicate": 0, "truncated": 0}, [], set()
        for _, role, text in own:
            signs = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not signs else "duplicate" if (role, text) in seen else "truncated" if signs[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            codes.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(own))
        cost, audit = cheapest(codes)
        lines, k, total = [], 0, sum(e != "D" for e in audit)
        for e in audit:
            if e != "D":
                given = "user" if (len(lines) - total % 2) % 2 == 0 else "assistant"
                lines.append((own[k][1] if e == "K" else given) + ":" + ("" if e == "I" else own[k][2]))
            k += e != "I"
        out[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(), illegal, cost, audit, sha("\n".join(lines))), lines
    return out


def check_repair(spark, rows, block=256):
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    want = plain_repair(rows)
    hurt = conversation.damaged(turns)
    repairs = conversation.repair_conversations(hurt, absent="absent", block=block)
    got = {r.conv_id: tuple(r)[1:] for r in repairs.collect()}
    assert got == {c: w for c, (w, _) in want.items()}
    lines = {}
    for r in sorted(conversation.repaired_turns(hurt.filter("not absent"), repairs).collect(), key=lambda r: r.place):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert lines == {c: x for c, (_, x) in want.items() if x}
    return want


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in queries.op11_conversation_repair(spark, SF).collect()}
    assert got == {c: w for c, (w, _) in plain_repair(rows).items()}
    assert sum(w[5] > 0 for w in got.values()) > 20


def test_op11_odd(spark):
    rng = random.Random(11)
    rows = [(None, None, None, None), (None, 3, "user", "x."), (1, None, "assistant", "a"), (1, None, "assistant", "a"), (2, 5, "", "　."), (3, 1, "system", "s!"), (4, 2, "user", "é" * 50_000 + ".")]
    for conv in range(5, 60):
        for _ in range(rng.randrange(1, 12)):
            rows.append((conv, rng.choice([None, *range(8)]), rng.choice(["system", "user", "assistant", "assistant", "user", "tool", None, "Users"]), rng.choice(["a.", "b?", "c", "", " \t", "d!  ", None, "e "])))
    # all that a conversation has may be dropped, and one may hold most rows, most of them alike
    rows += [(1000 + k, 0, "user", "gone.") for k in range(40)] + [(77, 4, "user", "same.")] * 30
    rows += [(78, k, ("user", "assistant")[rng.random() < 0.5], f"{k % 150}.") for k in range(400)]
    want = check_repair(spark, rows, block=16)
    assert any(w == (0, 0, 0, 0, 0, 0, "", sha("")) for w, _ in want.values())
    assert conversation.repair_conversations(conversation.damaged(spark.createDataFrame([], "conv_id long, turn long, role string, text string")), absent="absent").count() == 0


@pytest.mark.parametrize("block", [1, 3, 9])
def test_alignment(block):
    """Tables in bands, and blocks settled one by one, beside every edit."""
    rng = random.Random(block)
    for _ in range(300):
        code = "".join(rng.choice("suaxSUAXduaua") for _ in range(rng.randrange(30)))
        want = cheapest([(c.lower(), c == "d", c.isupper()) for c in code])
        assert min(conversation.align(code).values()) == want
        repair = conversation.Repair(1, block)
        for k, c in enumerate(code):
            repair.add(k, b"", b"%d" % k, "x" if c == "d" else c.lower(), 1 if c == "d" else 3 * c.isupper())
        assert repair.result()[6:8] == want


# --- op12


def plain_spans(text):
    """The base spans by their patterns."""
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c in "0123456789"]
        doubled = [d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(digits))]
        if 16 <= len(digits) <= 19 and sum(doubled) % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= sum(c in "0123456789" for c in m[0]) <= 15]


def test_op12(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = sorted((i, *(sum(s[0] == k for s in plain_spans(t or "")) for k in pii.BASE), sha(",".join(f"{k}:{b}:{e}" for k, b, e in plain_spans(t or "")))) for i, t in texts)
    got = queries.op12_personal_data(spark, SF).collect()
    assert sorted(tuple(r)[:6] for r in got) == want
    assert sum(sum(r[1:5]) for r in got) > 50
    for r in got:
        base = ",".join(s for s in r.spans.split(",") if s.split(":")[0] in pii.BASE)
        assert sha(base) == r.base_sha256
    assert any("secret:" in r.spans for r in got)


def test_op12_random():
    """Anchors and parsers beside patterns on texts made of what they turn on."""
    finder, rng = pii.Finder(), random.Random(12)
    for k in range(20_000):
        text = "".join(rng.choice("aé@.@-+ 0123456789..  ()%_/:\n") for _ in range(rng.randrange(60)))
        if k % 3 == 0:
            number = "".join(rng.choice("0123456789") for _ in range(rng.randrange(14, 19)))
            text += next(number + c for c in "0123456789" if pii.luhn(number + c)) + rng.choice([" 1", "-", "a", ""])
        if k % 5 == 0:
            text = ".".join(rng.choice(["1", "255", "256", "07", "0000000000000001"]) for _ in range(rng.randrange(4, 9))) + text
        assert [s for s in finder.find(text) if s[0] in pii.BASE] == plain_spans(text), text


@pytest.mark.parametrize(
    ("text", "masked"),
    [
        ("IBAN: DE89 3704 0044 0532 0130 00 and", "IBAN: [account] and"), ("IBAN: DE89 3704 0044 0532 0130 01 and", "IBAN: DE89 3704 0044 0532 0130 01 and"),
        ("see SSN 078-05-1120.", "see SSN [account]."), ("ssn 666-05-1120", "ssn 666-05-1120"), ("Account no. 12345678, x", "Account no. [account], x"), ("accounts 12345678", "accounts 12345678"),
        ("ftp://bob:pw@host/x).", "[address])."), ("http://[::1]:80/a, http://10.0.0.1/x", "[address], http://[ip]/x"), ("http://example.org/a 1999-2000", "http://example.org/a 1999-2000"),
        ('api_key="abcd1234abcd1234abcd"', 'api_key="[secret]"'), ("token abcdefghijklmnopqrstuvw", "token abcdefghijklmnopqrstuvw"), ("x@y.z é a.b@c.d.e.", "[email] é [email]."),
    ],
)
def test_op12_own_kinds(text, masked):
    assert pii.masked(text, pii.Finder().find(text)) == masked


def test_op12_odd(spark, odd_docs, no_docs):
    rows = pii.find_personal(odd_docs.withColumnRenamed("lang", "spans"), mask=True).collect()
    assert len(rows) == odd_docs.count() and all(r.spans == [] for r in rows)
    assert {r.masked for r in rows} == {r.text or "" for r in odd_docs.collect()}
    assert pii.find_personal(no_docs).count() == 0
    long = spark.createDataFrame([(1, "1 " * 300_000 + "a@b.c " + "+1-" * 100_000 + "@" * 100_000)], "doc_id long, text string")
    assert [tuple(s) for s in pii.find_personal(long).first().spans] == [("email", 600_000, 600_005)]


# --- op13


def plain_runs(words, least=12):
    """Every run by its definition: stretches of equal words q apart, for each q, the smallest first."""
    out, seen = [], set()
    for q in range(1, len(words) // 2 + 1):
        at = 0
        for same, group in itertools.groupby(range(len(words) - q), key=lambda i: words[i] == words[i + q]):
            size = len(list(group))
            start, length = at, size + q
            at += size
            if same and length >= max(2 * q, 2) and (start, length) not in seen:
                seen.add((start, length))
                if length >= least:
                    out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(doc_id, text):
    words, h = re.findall(r"[^\x20\x09-\x0D]+", text or ""), zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and words:
        n, g = len(words), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def collapsed(words, runs):
    return " ".join(w for i, w in enumerate(words) if not any(s + p <= i < s + n for s, n, p in runs))


def test_op13(spark):
    small = "/root/testdata/sf0.001"
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    texts = [(i, made(i, t)) for i, t in texts]
    got = {r.doc_id: r for r in queries.op13_periodic_runs(spark, small).collect()}
    assert len(got) == len(texts)
    for i, words in texts:
        if len(words) > 3000:  # the plain version takes the square
            continue
        runs = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=(None, None, None))
        want = (i, len(runs), *best, best[0] if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{n},{p}\n" for s, n, p in runs)), sha(collapsed(words, runs)))
        assert tuple(got[i]) == want
    assert sum(r.n_runs > 0 for r in got.values()) > 10


@pytest.mark.parametrize("least", [2, 4, 12])
def test_op13_random(least):
    rng = random.Random(least)
    for _ in range(1500):
        words = [rng.randrange(1, rng.choice([2, 3, 5])) for _ in range(rng.randrange(70))]
        if rng.random() < 0.4 and len(words) > 8:
            at, p = rng.randrange(len(words)), rng.randrange(1, 7)
            whole, words = len(words), words[: at + p]
            while len(words) < whole:
                words.append(words[-p])
        assert periodic.runs_of(words, least) == plain_runs(words, least)


def test_op13_odd(spark, odd_docs, no_docs):
    docs = odd_docs.withColumnRenamed("lang", "runs").unionByName(spark.createDataFrame([(9, "x " * 30_000 + "tail", None, None, None), (10, "a b c " * 3 + "a b", None, None, None), (11, "q a b c d e f a b c d e f z", None, None, None)], odd_docs.schema).withColumnRenamed("lang", "runs"))
    rows = periodic.find_runs(docs).collect()
    assert len(rows) == docs.count()
    by = {r.doc_id: r for r in rows}
    assert [tuple(x) for x in by[9].runs] == [(0, 30_000, 1)] and by[9].collapsed == "x tail"
    assert [tuple(x) for x in by[10].runs] == [] and by[10].collapsed == "a b c a b c a b c a b"
    assert [tuple(x) for x in by[11].runs] == [(1, 12, 6)] and by[11].collapsed == "q a b c d e f z"
    assert [tuple(x) for x in by[1].runs] == [(0, 30, 10)] and by[None].n_words in (0, 1) and by[6].collapsed == ""
    assert periodic.find_runs(no_docs).count() == 0
    # a null id, or an empty text, is never made periodic
    kept = periodic.made_periodic(odd_docs).filter("doc_id is null").collect()
    assert sorted(r.text or "" for r in kept) == ["", "tail"]
