import hashlib
import math
import re

from tests.llm.helpers import Tables, docs, empty_docs, odd_docs
from tillscope.llm import cooccur_sanitise as M


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (1 + i % 2)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def base(t):
    t = t or ""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 12 <= len(d) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return sorted(out)


def as_text(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in sorted(spans))


HAND = ["a@b.c_x@d.e a@b.c@d.e x 1.2.3.4.5.6.7.8 256.1.1.1 001.02.3.4", "+1 (499) 555-6503 4785380592391139", "4785 3805-9239 1139, 4111111111111111 x",
        "q 4111 1111 1111 1112", "é😀 hein.19@mail5.example.com, a@b a@b. a@-.-", "+1 23 +12345678 +123456789 +(1)23456789 +1234567890123456", None, "", "a." * 3000 + "@ x",
        "1." * 3000, "7" * 5000, "1 " * 3000, "+" * 2000 + "+1((((", "a@b.c" * 200, "0000000000000000", "999999999999999999999.1.1.1", "1.1.1.1@x.y"]


def test_base_findings(spark):
    got = {r.doc_id: r for r in M.op5_cooccur_sanitise(Tables(spark, documents=docs(spark, HAND)), "t").collect()}
    for i, t in enumerate(HAND):
        b = base(t)
        assert got[i].base_sha256 == hashlib.sha256(as_text(b).encode()).hexdigest()
        assert [got[i].n_email, got[i].n_ip, got[i].n_card, got[i].n_phone] == [sum(s[1] == k for s in b) for k in range(4)]


def corpus():
    out = [f"Contact Zebrafish Smithson at boss@corp.example please number {i}" for i in range(4)]
    out += [f"Please contact the desk of number {'x' * i}" for i in range(30)]
    out += [f"Smithson writes about gardens{'y' * i}" for i in range(2)]
    return out + ["rare lonely words once@corp.example here"] + ["nothing at all"] * 10


def test_disclosing_words(spark):
    texts = corpus()
    got = {r.doc_id: r for r in M.sanitise(docs(spark, texts), generalise_at=0.75, remove_at=0.95, with_text=True).collect()}
    n = len(texts)
    has = lambda w: sum(w in re.findall(r"[^\W\d_]{4,}", t.lower()) for t in texts)
    share = lambda w: math.log2(4 * n / (4 * has(w))) / math.log2(n / 4)
    want = {w: "remove" if share(w) >= 0.95 else "generalise" for w in ("contact", "zebrafish", "smithson", "please", "number") if share(w) >= 0.75}
    assert want == {"zebrafish": "remove", "smithson": "generalise"}
    for i in range(4):
        found = {texts[i][s.start: s.end].lower(): s.kind for s in got[i].terms}
        assert found == want
        assert got[i].sanitised == f"Contact  S++ at <email> please number {i}"
    for i in range(4, n):  # no support, no entity near: untouched
        assert got[i].terms == []
    assert got[4].sanitised == texts[4]


def test_odd_rows(spark):
    d = odd_docs(spark)
    assert M.sanitise(d).count() == d.count() and M.sanitise(empty_docs(spark)).count() == 0
    every = M.sanitise(docs(spark, ["mail me@x.y today"] * 5)).collect()  # an entity of all documents reveals nothing
    assert len(every) == 5 and all(r.terms == [] and len(r.base) == 1 for r in every)


def test_query_judges_all_words(spark):
    """Entities of one document, words far from the entity, short words and repeats; brute force over the query's spans."""
    far = "the " * 40
    texts = [f"Zoë met Quux at one@x.y {far}and quux went to Xi-Yo, {far}one quux", "call +1 (499) 555-6503 or mail two@x.y Bo", f"two@x.y {far}Bo", "Bo said Ko"]
    texts += [f"the and to at one met call or mail said went {'z' * i}" for i in range(60)] + ["again old@x.y " + "word " * 400 + "Rare" + " word" * 300, None]
    n = len(texts)
    runs = lambda t: list(re.finditer(r"[^\W\d_]+", t or ""))
    entities = lambda t: {(k, t[a:b]) for a, _, b, k in base(t)}
    held, has = {}, {}
    for i, t in enumerate(texts):
        for e in entities(t):
            held.setdefault(e, set()).add(i)
        for m in runs(t):
            has.setdefault(m[0].lower(), set()).add(i)
    share = lambda e, w: math.log2(n * len(held[e] & has[w]) / (len(held[e]) * len(has[w]))) / math.log2(n / len(held[e]))
    got = {r.doc_id: r.spans for r in M.op5_cooccur_sanitise(Tables(spark, documents=docs(spark, texts)), "t").collect()}
    kinds = set()
    for i, t in enumerate(texts):
        want = base(t)
        for m in runs(t):
            s = max((share(e, m[0].lower()) for e in entities(t)), default=0)
            if s >= 0.8 and not any(a < m.end() and m.start() < b for a, _, b, _ in base(t)):
                no = 5 if s >= 0.95 else 4
                want.append((m.start(), no, m.end(), M.KINDS[no]))
                kinds.add((M.KINDS[no], m[0]))
        assert got[i] == as_text(want)
    assert {("remove", "Quux"), ("remove", "quux"), ("remove", "Yo"), ("generalise", "Bo"), ("remove", "Rare")} <= kinds
