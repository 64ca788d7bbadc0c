import hashlib
import random
import re

from pitbars.llm import pii


def plain(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def test_base_spans_of_random_texts():
    rng = random.Random(3)
    for _ in range(20000):
        text = "".join(rng.choice("ab@@..-+1234567890 0%_é\n") for _ in range(rng.randrange(40)))
        assert pii.base_spans(text) == plain(text), repr(text)


def test_long_runs_end():
    for text in ("1" * 200000, "a" * 100000 + "@", "+1" + " " * 200000, "1." * 100000, "@" * 100000):
        pii.observe(text)


def corpus():
    """Phone numbers after a fixed phrase; some are written in a form only the phrase tells."""
    rng = random.Random(4)
    rows = []
    for k in range(40):
        number = f"+1 ({rng.randrange(200, 999)}) 555-{rng.randrange(1000, 9999)}"
        rows.append((k, f"Some words {k % 7} and then reach the office via hotline {number} today or later"))
    rows += [(100 + k, f"nothing else, reach the office via hotline 0{k}55-77{k}1x99 tomorrow") for k in range(3)]
    return rows + [(200 + k, f"order code 4411-77{k}3 was shipped") for k in range(20)]


def test_contexts_find_what_the_expressions_miss(docs):
    rows = corpus()
    got = {r["doc_id"]: r for r in pii.digest(pii.extract(docs(rows))).collect()}
    for i, text in rows:
        base = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in plain(text))
        assert got[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert got[i]["n_phone"] == sum(k == 3 for _, k, _ in plain(text))
        if i < 100 or i >= 200:
            assert got[i]["spans"] == base
        else:
            s = text.index("hotline ") + 8
            assert got[i]["spans"] == f"context_phone:{s}:{text.index(' tomorrow')}"


def test_masks(docs):
    out = pii.mask(docs(corpus()))
    assert out.columns == docs([]).columns
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[0]["text"].endswith("via hotline <PHONE> today or later") and by_id[0]["n_chars"] == len(by_id[0]["text"])
    assert by_id[101]["text"] == "nothing else, reach the office via hotline <PHONE> tomorrow"
    assert pii.masked("ab12cd", [(0, 0, 3), (2, 1, 5)]) == "<EMAIL>d"


def test_odd_rows(docs, odd):
    rows = odd + [(77, "é 日 a@b.co, 10.0.0.1; 4111 1111 1111 1111")]
    got = pii.digest(pii.extract(docs(rows))).collect()
    assert len(got) == len(rows)
    assert [r["spans"] for r in got if r["doc_id"] == 77] == ["email:4:10,ip:12:20,card:22:41"]
    assert pii.extract(docs([])).collect() == [] and pii.mask(docs([])).collect() == []


def test_contexts_find_spaced_numbers_and_fields(docs):
    forms = ["555 123 4567", "4111 1111 1111 1112", "(030) 1234567", "030 / 123 - 4567", "1" * 70]
    rows = [r for r in corpus() if r[0] < 40] + [(300 + k, f"please reach the office via hotline {x} today or later") for k, x in enumerate(forms)]
    got = {r["doc_id"]: r["text"] for r in pii.mask(docs(rows)).collect()}
    assert {got[300 + k] for k in range(len(forms))} == {"please reach the office via hotline <PHONE> today or later"}


def test_candidates_are_parts_of_fields():
    found = lambda t: [t[s:e] for s, e in pii.candidates(t, pii.base_spans(t))]
    assert found('{"a":"5551234567","b":99887766,"m":"x@y.example"}') == ["5551234567", "99887766"]
    assert found("a@b.example,123456,'77-88-99'") == ["123456", "77-88-99"]
    assert found("(555 123 4567). 2019") == ["555 123 4567"] and found("id=12345;k=67890") == ["12345", "67890"]
