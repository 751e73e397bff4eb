import random
import hashlib
import re

from scorelake.llm import secret_scan as S

RANKS = {"password": 1, "dragon": 50, "horse": 300, "monkey": 40}


def base(text):
    """The fixed patterns, run plainly."""
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m[2]) >= 8:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out)


TEXTS = [
    "", "nothing here", 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" x', "API_KEY: abcdefgh, apikey='short', PassWord=aaaaaaaa", "éé\U0001f600 secret=12345678 AKIAABCDEFGHIJKL1",
    "password=abc token=defghijk", "AKIA123", "0" * 31, "0" * 32 + "g" + "f" * 40, "tokenſ=abcdefghij toKen=abcdefghij", "secret secret: token=abcdefghi", "passwd\"  =  'q.w/e+r_t-y=u'",
]


def test_base_spans_are_the_stated_ones():
    for text in TEXTS:
        assert S.base_spans(text) == base(text), text
        got = S.scan(text, RANKS)
        joined = ",".join(f"{S.KINDS[k]}:{a}:{b}" for a, k, b in base(text))
        assert got["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest() and (got["n_guess"] or got["spans"] == joined)


def slow_cost(value, ranks):
    """The same costs by trying every segmentation."""
    import math
    from functools import cache

    low, spoken = value.lower(), value.lower().translate(S._SPOKEN)
    pieces = {}
    for a, b, c in S._walks(low) + S._repeats(low, ranks):
        pieces[a, b] = min(c, pieces.get((a, b), 99))

    @cache
    def best(a):
        if a == len(value):
            return 0.0
        found = []
        for b in range(a + 1, len(value) + 1):
            costs = [(b - a) * S.BRUTE]
            if (a, b) in pieces:
                costs.append(pieces[a, b])
            if 3 <= b - a <= S.LONGEST_WORD:
                for text, extra in ((low[a:b], 0.0), (spoken[a:b], S.NEXT)):
                    if text in ranks and (extra == 0.0 or low[a:b] not in ranks):
                        costs.append(math.log10(1 + ranks[text]) + extra + (S.NEXT if value[a:b] != low[a:b] else 0))
            found.append(min(costs) + (S.NEXT if a else 0.0) + best(b))
        return min(found)

    return best(0)


def test_cost_is_the_cheapest_segmentation():
    for value in ["password", "Dr4gonhorse", "zzqwertyzz", "monkeymonkeymonkey", "aaaa", "x", "abcdefmonkey", "p@ssword!!", "kx!vPq", "dragon.horse", ""]:
        assert abs(S.guess_cost(value, RANKS) - (slow_cost(value, RANKS) if value else 0.0)) < 1e-9, value
    dated = S.guess_cost("horse14-02-1987", RANKS)
    assert dated < S.guess_cost("horsekqzvwx!?pb", RANKS) and S.guess_cost("1987", RANKS) < 2


def test_only_costly_values_are_added():
    got = S.scan("my pwd = xK9#mQ2$vL7p! then pwd: password and pass is horse. https://user:kQ!9zz#Wp42@h/ Authorization: Bearer zQ8.kk-29XwvP1", RANKS)
    values = ["xK9#mQ2$vL7p", "kQ!9zz#Wp42", "zQ8.kk-29XwvP1"]
    text = "my pwd = xK9#mQ2$vL7p! then pwd: password and pass is horse. https://user:kQ!9zz#Wp42@h/ Authorization: Bearer zQ8.kk-29XwvP1"
    assert [text[int(s.split(":")[1]):int(s.split(":")[2])] for s in got["spans"].split(",")] == values


def test_short_random_values_are_added():
    ranks = RANKS | {"sunshine": 900}
    for value in ["xK9#mQ", "xK9#mQ2", "xK9#mQ2$", "kQ9zzW4t", "qjxkvzpw", "x7k2v9qd", "kQ!9zz#W", "q7#Lw2_pV", "Jt5vR8sXw2"]:
        for text in (f"my pwd = {value} end", f"passphrase: {value}", f"https://user:{value}@h/"):
            at = text.index(value)
            assert S.scan(text, ranks)["spans"] == f"guess:{at}:{at + len(value)}", text
    for value in ["sunshine", "Sunshine", "dr4gon", "monkeys", "dragonhorse", "14-02-1987", "19870214", "qwertyui", "123456789", "aaaaaaaa", "horse1987"]:
        assert S.scan(f"my pwd = {value} end", ranks)["spans"] == "", value


def test_odd_rows(spark, docs_of, odd_rows, clashing):
    rows = [*odd_rows, (8, TEXTS[2], "en", "a", 1)]
    got = S.secrets_query(docs_of(rows)).collect()
    assert len(got) == len(rows) and {r.doc_id: r.n_hex for r in got}[8] == 1 and all(r.spans == "" for r in got if r.doc_id != 8)
    assert S.secrets_query(docs_of([])).count() == 0
    assert S.secret_spans(clashing(docs_of(rows))).where("secrets.n_assign = 1").count() == 1
    assert S.word_ranks(docs_of(odd_rows), words=3) == {"some": 1, "again": 2, "here": 3} or len(S.word_ranks(docs_of(odd_rows), words=3)) == 3


def test_many_values_in_one_text():
    """Forty thousand values beside as many base spans, in seconds."""
    import time

    text = " ".join(f"password=abcdefgh{i} pwd: k{i}#Qz!x{i}" for i in range(20_000))
    start = time.time()
    out = S.scan(text, {})
    assert time.time() - start < 60 and out["n_assign"] == 20_000 and out["n_guess"] == 20_000


def test_taken_places_are_found_as_by_every_span():
    rng = random.Random(3)
    for _ in range(300):
        spans = sorted((a, rng.randrange(3), a + rng.randint(1, 12)) for a in (rng.randrange(60) for _ in range(rng.randrange(8))))
        starts, ends = S.merged_spans(spans)
        for _ in range(20):
            a = rng.randrange(60)
            b = a + rng.randint(1, 9)
            at = S.bisect_right(ends, a)
            assert (at < len(ends) and starts[at] < b) == any(s < b and a < e for s, _, e in spans)


def test_words_of_other_scripts_are_cheap(docs_of):
    texts = ["passphrase: спасибо", "password: пожалуйста-нет", "secret: ευχαριστώ", "passphrase: жq7#Zф9!кW"] + ["спасибо пожалуйста нет ευχαριστώ"] * 5
    got = {r.doc_id: r.n_guess for r in S.secrets_query(docs_of([(i, t, "xx", "a", 1) for i, t in enumerate(texts)])).collect()}
    assert [got[i] for i in range(4)] == [0, 0, 0, 1]
