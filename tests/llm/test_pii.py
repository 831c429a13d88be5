"""Spans against Python's own matches, and the counts behind telling terms."""

import math
import random
import re

from samples import ODD
from splicelake.llm import pii

PLAIN = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            out += [(kind, m.start(), m.end())] if good else []
    return out


def test_spans_are_those_of_the_plain_patterns(make_docs):
    own = random.Random(5)
    parts = ["a@b.c", "x_y@d-e.fg.", "@", ".", "_", "-", " ", "1.2.3.4", "0255.1.1.01", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5", "12", "+1 (555) 010-9999", "+", "(", "é", "𝒳", "\n", "z", "0"]
    rows = [(i, "".join(own.choice(parts) for _ in range(own.randint(1, 25)))) for i in range(400)] + [(500, "1" * 50_000), (501, "a" * 60_000 + "@"), (502, "1.2.3.4 " * 700), *ODD]
    got = sorted(((r.id, [(s.kind, s.start, s.end) for s in r.base]) for r in pii.all_spans(make_docs(rows)).collect()), key=str)
    assert got == sorted(((i, brute(t)) for i, t in rows), key=str)


def test_telling_terms_follow_the_counts(make_docs):
    rows = [(i, f"common words stand here number{i}") for i in range(60)]
    rows += [(100 + i, f"common Zorblax wrote to secret@mail.example about words {i}") for i in range(4)]
    out = {r.id: r for r in pii.all_spans(make_docs(rows)).collect()}
    n, both, entity = 64, 4, 4
    share = lambda n_term: math.log2(n * both / (n_term * entity)) / math.log2(n / entity)
    assert share(4) >= pii.REMOVE and share(64) < pii.GENERALISE
    text = dict(rows)
    for i in range(100, 104):
        assert {text[i][t.start : t.end] for t in out[i].terms} == {"Zorblax", "wrote", "to", "about"}
    assert all(not out[i].terms for i in range(60))


def brute_terms(rows):
    """(start, end, removed) of each text: every word against every entity, counts by sets of documents."""
    cut = re.compile(r"[^\W_]+")
    entity = lambda kind, v: (kind, re.sub("[^0-9]", "", v) if kind in ("card", "phone") else v.lower())
    words = [{w.lower() for w in cut.findall(t or "")} for _, t in rows]
    spans = [brute(t) for _, t in rows]
    owned = [{entity(k, t[a:b]) for k, a, b in s} for s, (_, t) in zip(spans, rows)]
    count, n, out = lambda sets, x: sum(x in s for s in sets), len(rows), []
    shares = {}
    for e in set().union(*owned):
        n_e, with_e = count(owned, e), [w for w, o in zip(words, owned) if e in o]
        for t in set().union(*with_e) if n > n_e else []:
            if (both := count(with_e, t)) >= pii.MIN_SUPPORT:
                shares[e, t] = math.log2(n * both / (count(words, t) * n_e)) / math.log2(n / n_e)
    for (i, t), s, o in zip(rows, spans, owned):
        own = []
        for m in cut.finditer(t or "") if o else []:
            best = max(shares.get((e, m[0].lower()), 0) for e in o)
            if best >= pii.GENERALISE and not any(a < m.end() and m.start() < b for _, a, b in s):
                own.append((m.start(), m.end(), best >= pii.REMOVE))
        out.append((i, own))
    return sorted(out, key=str)


def test_telling_terms_are_marked_wherever_they_stand(make_docs):
    far = "common words stand here " * 9
    rows = [(i, f"{far} number{i}") for i in range(60)]
    rows += [(100 + i, f"Zorblax {far} {'x' * 70} secret@mail.example {'y' * 64} {far} zorblax, ZORBLAX! 𝒳zorblax {far} 王小明 secret") for i in range(4)]
    out = {r.id: r for r in pii.all_spans(make_docs(rows)).collect()}
    text = dict(rows)
    for i in range(100, 104):
        assert [text[i][t.start : t.end] for t in out[i].terms] == ["Zorblax", "x" * 70, "y" * 64, "zorblax", "ZORBLAX", "𝒳zorblax", "王小明", "secret"]
    assert all(not out[i].terms for i in range(60))
    clean = {r.doc_id: r.text for r in pii.sanitised(make_docs(rows)).collect()}
    assert all("zorblax" not in clean[i].lower() and "王" not in clean[i] and "[email]" in clean[i] for i in range(100, 104))


def test_telling_terms_as_by_brute_force(make_docs):
    own = random.Random(8)
    vocabulary = [f"{a}{b}" for a in "abcdeÉ𝒳" for b in "xyzŻ9"]
    mails = ["me@x.example", "You@y.example", "ax@z.example", "+1 (555) 010-9999", "1.2.3.4"]
    rows = []
    for i in range(150):
        parts = [own.choice(vocabulary[:: own.choice([1, 3, 7])]) for _ in range(own.randint(0, 12))]
        if own.random() < 0.4:
            k = own.randrange(5)
            parts += [mails[k], *own.sample([f"n{k}", f"N{k}", f"m{k}", vocabulary[k]], 3), *(["filler"] * own.choice([0, 20])), f"n{k}"]
        own.shuffle(parts)
        rows.append((i, own.choice([" ", ", ", "\n"]).join(parts)))
    rows += [rows[3], rows[-1], *ODD]
    got = sorted(((r.id, [(t.start, t.end, t.removed) for t in r.terms]) for r in pii.all_spans(make_docs(rows)).collect()), key=str)
    want = brute_terms(rows)
    assert got == want and len({x[2] for _, s in want for x in s}) == 2


def test_sanitised_texts(make_docs):
    rows = [(1, "mail a@b.c or +1 (555) 010-9999, 1.2.3.4!"), (2, "nothing here"), (3, "4111 1111 1111 1111"), *ODD]
    docs = make_docs(rows)
    out = pii.sanitised(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    changed = {1: "mail [email] or [phone], [ip]!", 3: "[card]"}
    assert got == sorted(((i, changed.get(i, t) if i in (1, 3) and t and ("@" in t or "4111" in t) else t) for i, t in rows), key=str)


def test_empty_table(make_docs):
    assert pii.all_spans(make_docs([])).count() == 0 and pii.sanitised(make_docs([])).count() == 0


def test_the_plan_has_no_python(make_docs, capsys):
    pii.sanitised(make_docs(ODD[:3])).explain()
    assert not re.search("Python|Pandas|Arrow", capsys.readouterr().out)
