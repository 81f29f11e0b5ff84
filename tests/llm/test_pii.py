"""Personal data against plain versions of the patterns and of the rounds over contexts, and rules for odd inputs."""

import hashlib
import math
import random
import re

import pytest

pytest.importorskip("metricway.llm")

from metricway.llm import pii, queries  # noqa: E402
from metricway.llm.common import table  # noqa: E402

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, match):
    number = re.sub("[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(number)))
        return 12 <= len(number) <= 19 and total % 10 == 0
    return kind != "phone" or 9 <= len(number) <= 15


def base(text):
    order = list(PLAIN)
    out = [(m.start(), order.index(k), m.end(), k, m.group()) for k, p in PLAIN.items() for m in re.finditer(p, text or "")
           if passes(k, m.group())]
    return sorted(out)


def listed(spans):
    return ",".join(f"{k}:{s}:{e}" for s, _, e, k, *_ in sorted(spans))


def around(text, pattern):
    """(start, end, match, before, after) by the gaps between all matches of the pattern."""
    found = list(re.finditer(pattern, text))
    for i, m in enumerate(found):
        low = found[i - 1].end() if i else 0
        high = found[i + 1].start() if i + 1 < len(found) else len(text)
        yield m.start(), m.end(), m.group(), text[low:m.start()][-64:], text[m.end():high][:64]


def contexts(before, after):
    plain = re.sub("[0-9]", "0", before.lower())
    letter, other = r"[^\W\d_]", r"[\W\d_]"
    one = re.search(f"{letter}+{other}*$", plain)
    two = re.search(f"{letter}+{other}+{letter}+{other}*$", plain)
    following = re.match(f"{other}*({letter}+)", after.lower())
    out = [f"1:{one[0]}"] if one else []
    out += [f"2:{two[0]}"] if two else []
    return out + ([f"3:{one[0]}|{following[1]}"] if one and following else [])


TOKEN = r"(?<![A-Za-z0-9_.-])[A-Za-z_.-]*[0-9][A-Za-z0-9_.-]*"


def brute(texts):
    """The listed spans of each text."""
    spots = []
    for n, text in enumerate(texts):
        text = text or ""
        own = [(n, k, s, e, m, contexts(b, a)) for k, p in PLAIN.items() for s, e, m, b, a in around(text, p) if passes(k, m)]
        for s, e, m, b, a in around(text, TOKEN):
            core = m.lstrip("._-")
            s, core = s + len(m) - len(core), core.rstrip("._-")
            e = s + len(core)
            if sum(c in "0123456789" for c in core) >= 6 and not any(x[2] < e and s < x[3] for x in own if x[1]):
                own.append((n, None, s, e, core, contexts(b, a)))
        spots += own
    seeds = {m for _, k, _, _, m, _ in spots if k}
    edges = {(c, m, k) for _, k, _, _, m, cs in spots for c in cs if k or m not in seeds}
    known, before = {}, None
    for _ in range(pii.ROUNDS):
        sure = {}
        for c in {x[0] for x in edges}:
            own = [x for x in edges if x[0] == c]
            weight = dict.fromkeys(pii.KINDS, 0.0)
            total = 1.0
            for _, m, k in own:
                if k or m in known:
                    kind, score = (k, 1.0) if k else known[m]
                    weight[kind] += score
                    total += 1
                else:
                    total += pii.UNKNOWN
            most, kind = max((w, k) for k, w in weight.items())
            if most >= pii.SUPPORT and most / total >= pii.CONFIDENT:
                sure[c] = kind, min(most / total, pii.CERTAIN)
        scores = {}
        for c, m, k in edges:
            if k is None and c in sure:
                kind, share = sure[c]
                scores.setdefault((m, kind), []).append(share)
        best = {}
        for (m, kind), shares in scores.items():
            score = round(1 - math.prod(1 - s for s in shares), 9)
            best[m] = max(best.get(m, (0, "")), (score, kind))
        known = {m: (k, s) for m, (s, k) in best.items() if s >= pii.ACCEPTED}
        if known == before:
            break
        before = known
    order = list(PLAIN)
    out = []
    for n, text in enumerate(texts):
        more = [(s, order.index(known[m][0]), e, known[m][0]) for i, k, s, e, m, _ in spots if i == n and not k and m in known]
        out.append(listed([*base(text), *more]))
    return out


def found(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = pii.found(df).select("doc_id", pii.listed(pii.F.col("spans")).alias("s")).collect()
    return [r.s for r in sorted(rows)]


def test_query_against_plain_patterns(spark, sf):
    docs = sorted((r.doc_id, r.text) for r in table(spark, sf, "documents").collect())
    want = dict(zip([d for d, _ in docs], brute([t for _, t in docs])))
    texts, seen = dict(docs), 0
    for r in queries.bootstrapped_pii(spark, sf).collect():
        own = base(texts[r.doc_id])
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(x[3] == k for x in own) for k in PLAIN)
        assert r.base_sha256 == hashlib.sha256(listed(own).encode()).hexdigest() and r.spans == want[r.doc_id]
        seen += len(own)
    assert seen


def test_contexts_discover_unseen_numbers(spark):
    """Numbers of other forms behind the words that seeds stand behind are found in two steps; numbers elsewhere are not."""
    rng = random.Random(2)
    number = lambda: f"+1 ({rng.randrange(100, 999)}) 555-{rng.randrange(1000, 9999)}"
    texts = [f"Word {chr(97 + i)} then call me at {number()} or not." for i in range(8)]
    texts += ["Now call me at 555-01234567, dear.", "We ordered 1234567 screws on 2024-05-17.", "Her desk line rings 555-01234567."]
    # Found numbers teach a context of their own.
    texts += [f"Please call me at 555-9{i}00001 today." for i in range(6)] + [f"The desk line rings 555-9{i}00001 often." for i in range(6)]
    texts += ["Her desk line rings 555-7654321."]
    got = found(spark, texts)
    assert got == brute(texts)
    assert got[8] == "phone:15:27" and got[9] == "" and got[10] == "phone:20:32" and got[-1] == "phone:20:31"


def test_mixed_contexts_teach_nothing(spark):
    texts = [f"It is {x} here" for i in range(5) for x in (f"a{i}@b.org", f"10.0.0.{i}", f"+1 (20{i}) 555-0000")] + ["It is 123456789 here"]
    assert found(spark, texts)[-1] == "" and found(spark, texts) == brute(texts)


def test_random_characters(spark):
    rng = random.Random(6)
    pieces = ["@", ".", "-", "+", " ", "(", ")", "1", "22", "255", "256", "a", "b.c", "é", "_", "%", "4111 1111 1111 1111", "日",
              "1.2.3.4", "x@y.z", "+1 (202) 555-0000", "\n", "😀"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    assert found(spark, texts) == brute(texts)


def test_odd_rows(spark):
    def long(n):
        return "1" * n + " " + "a" * n + "@ " + "1." * (n // 4) + " " + "x@y.z, 10.0.0.1 " * 3000
    texts = [None, "", "x@y.z", "x@y.z", "a@" + "b." * 20_000 + "c", long(400), long(200_000)]
    df = spark.createDataFrame([(None if i < 2 else 5, t, i, "p") for i, t in enumerate(texts)],
                               "doc_id long, text string, row int, own string")
    out = {r.row: [(s.start, s.kind, s.end) for s in r.base] for r in pii.found(df).collect() if r.own == "p" and r.spans == r.base}
    assert sorted(out) == list(range(len(texts)))
    for i, t in enumerate(texts[:-1]):  # the plain patterns take the square of the longest
        assert ",".join(f"{k}:{s}:{e}" for s, k, e in out[i]) == listed(base(t))
    kinds = [k for _, k, _ in out[6]]
    assert kinds == [k for _, k, _ in out[5]] or kinds.count("email") == 3000
    assert pii.found(df.limit(0)).count() == 0 and pii.found(df).columns == ["doc_id", "row", "own", "base", "spans"]
    with pytest.raises(ValueError):
        pii.found(df.withColumnRenamed("own", "spans"))
