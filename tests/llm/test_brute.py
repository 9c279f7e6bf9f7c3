"""Operators against plain versions of themselves."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from askwell.llm import decontaminate, language, line_dedup, minhash, packing, quality_model, secret_scan, token_counts, tokens
from askwell.plans.inputs import table

SF = "/root/testdata/sf0.001"


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at = next(j for j in range(min(len(word), at + longest), at, -1) if word[at:j] in vocabulary)
        n += 1
    return n


def test_automaton_counts_as_greedy_longest_match():
    pick = random.Random(3)
    for _ in range(60):
        vocabulary = {bytes([b]) for b in range(256)} | {bytes(pick.choices(b"abc", k=pick.randint(2, 7))) for _ in range(pick.randint(0, 25))}
        words = [bytes(pick.choices(b"abcd", k=pick.randint(0, 20))) for _ in range(50)]
        assert token_counts.Automaton.of(vocabulary).counts(words).tolist() == [greedy(w, vocabulary, 7) for w in words]


def test_token_counts_of_documents(spark):
    ranks = tokens.byte_ranks(tokens.vocabulary_path(token_counts.VOCABULARY))
    longest = max(map(len, ranks))
    docs = table(spark, SF, "documents")
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in token_counts.token_counts(docs).where("doc_id < 40").collect():
        words = texts[r["doc_id"]].split()
        assert (r["n_words"], r["n_tokens"]) == (len(words), sum(greedy(b" " + w.encode(), ranks, longest) for w in words))


def test_encoder_gives_the_tokenizers_ids():
    import public_tokenizers

    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    plain.encode_special_tokens = True
    pick = random.Random(1)
    alphabet = ["a", "b", "é", " ", "  ", "\n", "\t", "1", "23", "!", "'s", "'", "the", " ", "漢", "😀", "<|endoftext|>", "́", "\x00", "\x1c", "\x85"]
    texts = ["".join(pick.choices(alphabet, k=pick.randint(0, 30))) for _ in range(4000)]
    ids, counts = tokens.Encoder(tokens.vocabulary_path(packing.VOCABULARY))(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [e.ids for e in plain.encode_batch(texts, add_special_tokens=False)]


def test_hilbert_neighbours():
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = packing.hilbert_keys(grid, 3)
    assert sorted(keys) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def check_pieces(rows, texts):
    encode = tokens.Encoder(tokens.vocabulary_path(packing.VOCABULARY))
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    want = {i: np.append(encode([t])[0], 1).astype("<u4") for i, t in texts.items()}
    for r in rows:
        assert zlib.crc32(want[r["doc_id"]][r["start"] : r["start"] + r["length"]].tobytes()) == r["ids_crc32"]
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for pieces in (*by_doc.values(), *by_sequence.values()):
        assert [s for s, _ in sorted(pieces)] == np.r_[0, np.cumsum([n for _, n in sorted(pieces)])][:-1].tolist()
    assert {i: sum(n for _, n in v) for i, v in by_doc.items()} == {i: len(w) for i, w in want.items()}
    sizes = [sum(n for _, n in v) for v in by_sequence.values()]
    assert all(n & (n - 1) == 0 and n <= 2048 for n in sizes)


def test_packing_round_trip(spark):
    docs = table(spark, SF, "documents")
    check_pieces(packing.packed(docs).collect(), {r["doc_id"]: r["text"] for r in docs.collect()})


def shingles(text, k):
    words = text.encode().lower().split()
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute_components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(i for i in texts if sets[i])
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            n = len(sets[a] & sets[b])
            if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
                p, q = sorted((find(a), find(b)))
                root[q] = p
    return {i: find(i) for i in texts}


def family(pick, n, size, changed):
    base = [f"w{pick.randint(0, 5000)}" for _ in range(size)]
    out = []
    for _ in range(n):
        words = list(base)
        for _ in range(pick.randint(0, changed)):
            words[pick.randrange(size)] = f"x{pick.randint(0, 10**6)}"
        out.append(" ".join(words))
    return out


def test_near_duplicates_of_borderline_families(spark):
    """Families where the first leader is similar to part of the members only, larger than a block."""
    pick = random.Random(5)
    texts = [t for n, changed in ((300, 14), (40, 8), (5, 3), (2, 1)) for t in family(pick, n, 120, changed)] + ["Lone TEXT", "lone text", "", "one"]
    pick.shuffle(texts)
    texts = dict(enumerate(texts, 10))
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string")
    for k in (2, 5):
        got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, k, 80).collect()}
        assert got == brute_components(texts, k, 80)


def test_rows_of_one_id_join_their_classes(spark):
    x, y, z = ("one text of some words here", "another text of quite other words", "a third one that is alone here")
    docs = spark.createDataFrame([(0, y), (1, x), (1, y), (2, x), (3, z)], "doc_id bigint, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs, 2, 80).collect()}
    assert got == {(0, 0, True), (1, 0, False), (2, 0, False), (3, 3, True)}


def test_sketch_fills_every_bin_and_estimates():
    random_bits = np.random.default_rng(2)
    for n in (1, 2, 7, 1000):
        assert len(minhash.sketch(np.unique(random_bits.integers(0, 2**63, n).astype(np.uint64)))) == minhash.BINS
    a = np.unique(random_bits.integers(0, 2**63, 900).astype(np.uint64))
    agree = np.mean([(minhash.sketch(a[i : i + 800]) == minhash.sketch(a[i + 100 : i + 900])).mean() for i in range(0, 1)])
    assert abs(agree - 700 / 900) < 0.15


def test_template_windows_catch_other_numbers_and_names(spark):
    item = "John Doe bought 5 lb of apples for 20 dollars and then John gave 2 lb away to Mary."
    docs = spark.createDataFrame([
        (1, "Before. Anna Miller bought 7 kg of apples for 21 euros and then Anna gave 3 kg away to Peter. After"),
        (2, "If Anna Miller bought 7 kg of apples for 21 euros and then Bob gave 3 kg away to Bob now"),
        (3, f"Once more: {item} And {item}"), (4, "A farmer bought two sacks of apples for his horses and then went away to town."),
    ], "doc_id bigint, text string")
    found = decontaminate.contaminations(docs, spark.createDataFrame([(9, item)], "item_id bigint, text string")).collect()
    assert sorted((r["doc_id"], r["item_id"], r["exact"]) for r in found) == [(1, 9, False), (3, 9, True), (3, 9, True)]


def test_benchmark_items_in_documents(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminations(docs, items).collect()}
    rows = items.collect()
    assert got == {(d["doc_id"], i["item_id"]) for d in docs.collect() for i in rows if i["text"] in d["text"]}


def contaminated(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id bigint, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    return {(r["doc_id"], r["item_id"], r["exact"]) for r in decontaminate.contaminations(docs, items).collect()}


def test_short_items_are_found_in_other_surroundings(spark):
    items = ["Which planet in our solar system has the most moons?", "The old river near Paris runs through nine big towns. It ends there."]
    copies = [[f"Question: {x} Answer:", x.lower(), re.sub(r"[.?]", "", f"so {x}"), x.title()] for x in items]
    got = contaminated(spark, items, [c for x in copies for c in x] + ["Which planet of our solar system has the least moons?"])
    assert got == {(4 * i + j, i, True) for i in range(2) for j in range(4)}


def test_items_of_few_tokens_or_few_words(spark):
    items = ["What is the capital of France?", "12 + 45 * 3 - 7 = ?", "Anna Bell, Carl Dorn, Eva Frank, Gil Hart, Ida Jung", " ".join(map(str, range(100, 130)))]
    got = contaminated(spark, items, [f"Some words. Question: {x} And more." for x in items] + ["We had 12 - 45 + 3 * 7 of it", "1 12 45 3 8", "the capital of France"])
    assert got == {(i, i, True) for i in range(4)}


def test_changed_numbers_need_not_agree(spark):
    items = ["Tom has 5 apples and 3 pears in his basket and eats one of them each day", "If 2 trains need 2 hours for the whole way how long do they need for half"]
    long = "There are 7 days and 7 nights of which " + " ".join(f"{w} {v}" for w in ("red", "blue", "old", "new", "big") for v in ("house", "garden", "road", "river", "town"))
    docs = ["Tom has 4 apples and 4 pears in his basket and eats one of them each day", "If 3 trains need 5 hours for the whole way how long do they need for half", long.replace("7 nights", "8 nights")]
    assert contaminated(spark, [*items, long], docs) == {(0, 0, False), (1, 1, False), (2, 2, False)}
    item = f"{long} and then John met Mary who saw that John was there"
    assert contaminated(spark, [item], [item.replace("that John", "that Bob")]) == {(0, 0, False)}


def plain_spans(text):
    """The patterns as the contract gives them, matches that are too short dropped afterwards."""
    kinds = (
        (r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 12),
        (r"AKIA[A-Z0-9]+", 0, 18), (r"[0-9a-f]+", 0, 16),
    )
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text) if len(m[g]) >= n]
    return ",".join(f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found))


def test_base_spans():
    pick = random.Random(4)
    parts = ["password", "PASSWD", "Token", "api_key", "ſecret", "toKen", ":", "=", " ", "\"", "'", "abcdef012345", "AKIA", "ABCDEFGH234567", "0123456789abcdef", "é", "\n", "x."]
    for _ in range(5000):
        text = "".join(pick.choices(parts, k=pick.randint(0, 12)))
        assert secret_scan.joined(secret_scan.base_spans(text)) == plain_spans(text)


def test_guess_cost_is_the_cheapest_cut():
    ranks = secret_scan.word_ranks(secret_scan.vocabulary_path(secret_scan.WORDS))
    cost = lambda v: secret_scan.guess_cost(v, ranks)[0]
    assert max(map(cost, ("password", "qwertyuiop", "aaaaaaaaaaaa", "abcabcabcabc", "19840512", "summer2019", "12345678"))) < 8
    assert min(map(cost, ("x7$Kq9!vLm", "Zr4-pPq8_wUy"))) > 14
    pick = random.Random(6)
    for _ in range(30):  # against trying every cut
        value = "".join(pick.choices(["the", "1", "a", "aaa", "2019", "Q"], k=4))[:9]
        found = collections.defaultdict(lambda: float("inf"))
        for i, j, c, _ in secret_scan.pieces(value, ranks):
            found[i, j] = min(found[i, j], c)
        per_char = np.log10(secret_scan.alphabet(value))

        def cheapest(at, brute):
            if at == len(value):
                return 0.0
            step = per_char + (0 if brute or at == 0 else 0.3) + cheapest(at + 1, True)
            return min([step, *(c + (0.3 if i else 0) + cheapest(j, False) for (i, j), c in found.items() if i == at)])

        assert abs(cheapest(0, False) - cost(value)) < 1e-9
    spans = secret_scan.scan("the password is hunter2, passwd: x7$Kq9!vLm", ranks)["spans"]
    assert spans == "password:33:43"


def test_long_values_and_camel_case_keys():
    ranks = secret_scan.word_ranks(secret_scan.vocabulary_path(secret_scan.WORDS))
    pick = random.Random(7)
    key = "".join(pick.choices("abcdefghijkXYZ0123456789-_", k=400))
    assert secret_scan.scan(f"credential={key} and auth: {'xy1' * 5000}", ranks)["spans"] == "password:11:411"
    for name in ("dbPassword", "userPwd", "DBPassword", "db_password"):
        assert secret_scan.scan(f"{name} = Zr4-pPq8", ranks)["spans"] == f"password:{len(name) + 3}:{len(name) + 11}"
    assert secret_scan.scan("compass = Zr4-pPq8", ranks)["spans"] == ""
    for _ in range(3000):  # the bounded programme decides as the whole one does
        value = "".join(pick.choices(["the", "1", "aaa", "2019", "Q", "qwer", "Pass", "$", "abab", "x7", "é", "drow"], k=pick.randint(1, 6)))
        cost = secret_scan.guess_cost(value, ranks)[0]
        assert all(secret_scan.costs_at_least(value, ranks, least) == (cost >= least) for least in (5.0, 10.0, cost))


def test_random_letters_are_secrets_and_words_are_not():
    ranks = secret_scan.word_ranks(secret_scan.vocabulary_path(secret_scan.WORDS))
    found = lambda text: secret_scan.password_spans(text, ranks, secret_scan.LEAST_LOG10)
    assert found('pwd = "qZxTvBnKwLpRmD"') == [(7, 3, 21)] and found("the token is xkqzvwjpht.") == [(13, 3, 23)] and found("secret: hVkTzRwq") == [(8, 3, 16)]
    words = "incorrect unbelievable misconfigured hexadecimal Kennwort Zugangsberechtigung obligatoire confidencial contraseña Benutzername REQUIRED"
    assert not any(found(f"the password is {w}") or found(f"Token: {w}.") for w in words.split())


def test_held_out_accuracy(spark):
    docs, labels = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    langs = {r["doc_id"]: r["lang"] for r in docs.collect()}
    found = [r for r in language.languages(docs).collect() if r["held_out"]]
    assert np.mean([r["lang_pred"] == langs[r["doc_id"]] for r in found]) > 0.98
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    scores = [(r["predicted"], truth[r["doc_id"]]) for r in quality_model.quality_scores(docs, labels).collect() if r["held_out"] and r["doc_id"] in truth]
    assert np.mean([p == q for p, q in scores]) > 0.9


def test_mixture_of_two_languages(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = language.learn(docs)
    first = {}
    for r in docs.where("n_chars between 1500 and 4000").collect():
        first.setdefault(r["lang"], r["text"])
    shares, taken = model.mixtures([first["en"][:1400] + "\n" + first["de"][:1400], first["fr"]])
    assert taken.tolist() == [2, 1] and shares[1, model.languages.index("fr")] == 1
    assert all(0.25 < shares[0, model.languages.index(x)] < 0.75 for x in ("en", "de"))


def plain_pipeline(docs, items):
    """The stages after language ID, one row at a time."""
    import hashlib

    md5 = lambda s: hashlib.md5(s.encode()).hexdigest()
    is_long = lambda s: len(s) > 100 and s.count(" ") >= 50
    first, chunks = {}, {}
    for i, text in sorted(docs.items()):
        lines = text.split("\n")
        hashes = [md5(x) for x in lines]
        r = [md5(a + b) for a, b in zip(hashes, hashes[1:])]
        low = {k for k in range(2, len(r)) if r[k] < r[k - 1] and (k + 1 == len(r) or r[k] <= r[k + 1])}
        long = {k for k, x in enumerate(lines) if is_long(x)}
        begins = sorted(({0} | low | long | {k + 1 for k in long}) - {len(lines)}) + [len(lines)]
        chunks[i] = ["\n".join(lines[a:b]) for a, b in zip(begins, begins[1:])]
    kept = {}
    for i, parts in chunks.items():
        fit = [len(c) >= 32 and ("\n" in c or is_long(c)) and c.split() != [] for c in parts]
        left = [c for k, (c, ok) in enumerate(zip(parts, fit)) if not ok or first.setdefault(c, (i, k)) == (i, k)]
        if len(left) == len(parts) or "\n".join(left).strip(" \t\n\x0b\f\r"):
            kept[i] = "\n".join(left)
    component = brute_components(kept, 5, 80)
    kept = {i: t for i, t in kept.items() if component[i] == i}
    return {i: t for i, t in kept.items() if not any(x in t for x in items)}


def test_pipeline(spark):
    docs, items = table(spark, SF, "documents"), table(spark, SF, "benchmark")
    known = {r["doc_id"]: r["text"] for r in language.identified(docs).collect()}
    assert len(known) >= 0.97 * docs.count()
    want = plain_pipeline(known, [r["text"] for r in items.collect()])
    check_pieces(corpus_pipeline.run(spark, SF).collect(), want)


def test_line_chunks_move_with_what_is_before(spark):
    pick = random.Random(8)
    shared = [f"Line {k} of a passage that many documents have {pick.random()}" for k in range(40)]
    docs = spark.createDataFrame([(i, "\n".join([f"own line {i} {k}" for k in range(i)] + shared)) for i in range(1, 9)], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in line_dedup.line_dedup(docs).collect()}
    assert rows[1]["n_removed"] == 0 and all(rows[i]["n_removed_lines"] >= 25 for i in range(2, 9))


def test_long_lines_go_whatever_stands_around_them(spark):
    long, short = " ".join(f"word{k}" for k in range(51)), " ".join(f"term{k}" for k in range(50))
    texts = ["\n".join([f"own {i}", long, f"more {i}", short, f"end {i}"]) for i in range(20)] + [long, short, "x\n" + long, long + "\n" + long]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {r["doc_id"]: r["text"] for r in line_dedup.line_dedup(docs).collect()}
    assert rows[0] == texts[0] and all(rows[i] == texts[i].replace(long + "\n", "") for i in range(1, 20))
    assert (rows[20], rows[21], rows[22], rows[23]) == ("", short, "x", "")


def test_values_of_further_contexts_are_secrets():
    ranks = secret_scan.word_ranks(secret_scan.vocabulary_path(secret_scan.WORDS))

    def found(text):
        return [text[s:e] for s, _, e in secret_scan.password_spans(text, ranks, secret_scan.LEAST_LOG10)]

    assert found('password = "Zr4,pPq8;wUy>k9"') == ["Zr4,pPq8;wUy>k9"] and found('pwd="k9;Zr4pPq8wUyXq"') == ["k9;Zr4pPq8wUyXq"]
    assert found('passphrase = "correct horse battery staple violin"') == ["correct horse battery staple violin"]
    assert found('password => "x7$Kq9!vLm"') == ["x7$Kq9!vLm"] and found("see https://bob:x7$Kq9!vLm@host/ for it") == ["x7$Kq9!vLm"]
    assert found("run --password x7$Kq9!vLm --db-password 'Zr4 pPq8 wUy'") == ["x7$Kq9!vLm", "Zr4 pPq8 wUy"]
    assert found("<password>x7$Kq9!vLm</password><db_password>Zr4-pPq8wU</db_password>") == ["x7$Kq9!vLm", "Zr4-pPq8wU"]
    assert found('"password": "x7$Kq9!vLm", "token": "it is a word in quotes, no more"') == ["x7$Kq9!vLm"]
    assert found("token=https://bob:x7$Kq9!vLm@host/") == ["https://bob:x7$Kq9!vLm@host/"]  # one span, not two
    for prose in ('secret: "a long walk by the river in the evening"', "the password is required here", "--token file is read", "http://host:8080/p@x", "<pass>unclosed", 'password="', "password='short'", "pass the salt: thanks"):
        assert found(prose) == [], prose
    assert found('password="x7$Kq9!vLm') == ["x7$Kq9!vLm"]  # never closed
    found('password = "' * 20_000)  # ends


def test_rows_of_the_query_are_those_of_a_plain_scan(spark):
    docs = table(spark, SF, "documents")
    ranks = secret_scan.word_ranks(secret_scan.vocabulary_path(secret_scan.WORDS))
    got = {r["doc_id"]: r for r in secret_scan.secrets(docs).collect()}
    texts = docs.select("doc_id", "text").collect()
    assert len(got) == len(texts)
    for row in texts:
        base = plain_spans(row["text"] or "")
        more = secret_scan.password_spans(row["text"] or "", ranks, secret_scan.LEAST_LOG10)
        found = got[row["doc_id"]]
        assert found["base_sha256"] == hashlib.sha256(base.encode()).hexdigest()
        assert set(base.split(",")) - {""} <= set(found["spans"].split(",")) and found["n_password"] == len(more)
