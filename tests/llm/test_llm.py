"""The ten operators against plain models on small fixtures, with nulls, empties, repeats and clashing columns."""

import collections
import random
import zlib

import numpy as np
import pytest

from corvina.llm import bpe, chat, components, langid, line_dedup, minhash, packing, quality, queries, token_counts, vector_graph, warc

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau".split()


def prose(seed, n=60):
    r = random.Random(seed)
    return "\n".join(" ".join(r.choice(WORDS) + str(r.randint(0, 99)) for _ in range(8)) + "." for _ in range(n // 8 + 1))


def docs(spark, texts, more="n_words int, id string, text_hash long, pos int"):
    """Documents with columns whose names operators use inside."""
    return spark.createDataFrame([(k, t, "en", "s", None, None, None, None, None) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long, " + more)


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.tokenizer())


ODD = [None, "", " ", "a  b\n\n c\t\r\n", "é à\u00a0 \u00a0x", "<|endoftext|>x <|endoftext|>", "中文 text 😀!!", "x" * 5000, "it's we'll \x1c y", prose(1), prose(1), "ab " * 9000]


def test_bpe_equals_library(spark, reference_tokenizer):
    both = {r["id"]: r for r in bpe.decode(bpe.encode(docs(spark, ODD), queries.tokenizer()), queries.tokenizer()).collect()}
    for k, t in enumerate(ODD):
        ids = reference_tokenizer.encode(t or "", add_special_tokens=False).ids
        assert both[k]["ids"] == ids and both[k]["text"] == reference_tokenizer.decode(ids, skip_special_tokens=False)


def test_bpe_on_random_strings(reference_tokenizer):
    r, own = random.Random(3), bpe.loaded(bpe.definition(queries.tokenizer()))
    parts = ["a", "the", " ", "  ", "\n", "\t", "\u3000", "\x85", "é", "1", "²", "!", "'s", "'", "ll", "'re", "中", "<|endoftext|>", "\u200d", "\x00", "\x1c", "İ"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 14))) for _ in range(5000)] + ["", "x" * 20_000, "中文字" * 3000]
    flat, at = own.encode_batch(texts)
    for t, x, y in zip(texts, at, at[1:]):
        assert flat[x:y].tolist() == reference_tokenizer.encode(t, add_special_tokens=False).ids


def test_bpe_encodes_long_texts_in_sections(reference_tokenizer, monkeypatch):
    own = bpe.loaded(bpe.definition(queries.tokenizer()))
    monkeypatch.setattr(bpe, "SECTION", 50)
    texts = [prose(3, 400) + "  \n\n x<|endoftext|>  'tis  it's \u3000 y", None, "", " " * 300, "a" * 300, "é\n" * 200, "<|endoftext|>" * 3] + ODD
    flat, at = own.encode_batch(texts)
    assert len(bpe.sections(texts[0])) > 20 and "".join(bpe.sections(texts[0])) == texts[0]
    for t, x, y in zip(texts, at, at[1:]):
        assert flat[x:y].tolist() == reference_tokenizer.encode(t or "", add_special_tokens=False).ids


def test_bpe_knows_every_character(reference_tokenizer):
    own = bpe.loaded(bpe.definition(queries.tokenizer()))
    texts = [f"a{chr(c)}1 {chr(c)}" for c in range(0, 0x30000) if not 0xD800 <= c < 0xE000]
    flat, at = own.encode_batch(texts)
    for t, e, x, y in zip(texts, reference_tokenizer.encode_batch(texts, add_special_tokens=False), at, at[1:]):
        assert flat[x:y].tolist() == e.ids, hex(ord(t[1]))


def test_bpe_cuts_at_every_forced_pair():
    own = bpe.loaded(bpe.definition(queries.tokenizer()))
    inside = {(a, b) for t in own.tokens for a, b in zip(t, t[1:])} - set(zip(b"<|endoftext|>", b"|endoftext|>"))
    text = prose(1) + " 中文字é, x9z\n  'tis qQzXj"
    fragments, at = own.fragments([text])
    fragments = fragments.to_pylist()
    assert b"".join(fragments).decode() == text and at.tolist() == [0, len(fragments)]
    assert all((a, b) in inside or own.inside[a << 8 | b] for f in fragments for a, b in zip(f, f[1:]))
    # No fragment could be cut further; pairs that no token holds always part fragments.
    assert (~own.inside).sum() > 60_000 and max(map(len, fragments)) < 20


def test_bpe_refuses_other_definitions():
    import json

    spec = json.loads(bpe.definition(queries.tokenizer()))
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [{"id": 1, "content": "x", "lstrip": True}]}):
        with pytest.raises(ValueError):
            bpe.accepted(spec | change)


def test_packing(spark, reference_tokenizer):
    texts = [*ODD, *(prose(k, 20 + 7 * k) for k in range(30))]
    rows = packing.pack(docs(spark, texts), queries.tokenizer(), 256, 0).collect()
    by_doc, by_seq = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        by_doc[r["id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for k, t in enumerate(texts):
        ids = [*reference_tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
        own = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in own] == list(range(-(-len(ids) // 256))) and all(r["length"] == 256 for r in own[1:])
        for r in own:
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], dtype="<u4").tobytes())
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 256
    total = sum(r["length"] for r in rows)
    assert len(by_seq) <= -(-total // 256) * 1.1 + 2


def best_fit_decreasing(sizes, capacity):
    gaps, opened = np.zeros(capacity + 1, int), 0
    for s in sorted(sizes, reverse=True):
        fit = np.flatnonzero(gaps[s:])
        at = fit[0] + s if len(fit) else capacity
        gaps[at] -= len(fit) > 0
        gaps[at - s] += 1
        opened += not len(fit)
    return opened


def plain_sum_of_squares(sizes, capacity):
    """The rule piece by piece, longest first: the sequences, each the list of its pieces."""
    bins, opened = collections.defaultdict(list), []
    for size in sorted(sizes, reverse=True):
        fit = [g for g in bins if g >= size and bins[g]]
        if fit:
            def squares(g):
                n = {k: len(v) for k, v in bins.items()}
                n[g] -= 1
                n[g - size] = n.get(g - size, 0) + 1
                return sum(v * v for k, v in n.items() if k)

            gap = min(fit, key=lambda g: (squares(g), g))
            own = bins[gap].pop()
        else:
            gap, own = capacity, []
            opened.append(own)
        own.append(size)
        bins[gap - size].append(own)
    return opened


@pytest.mark.parametrize("seed", range(6))
def test_plan_follows_the_rule_piece_by_piece(seed):
    r = random.Random(seed)
    sizes = [[r.randint(1, 60) for _ in range(300)], [25] * 9, [min(60, int(r.lognormvariate(2.5, 1)) + 1) for _ in range(300)], [33] * 20 + [27] * 21 + [5] * 7, [60] * 5, [20] * 3 + [40]][seed]
    runs = packing.plan(collections.Counter(sizes), 60)
    assert runs[runs[:, 4] == 0][:, 2].sum() == len(plain_sum_of_squares(sizes, 60))


def taken_by_the_rule(counts, capacity):
    """How often pieces of each length take each gap, piece by piece on the numbers of open sequences."""
    n, taken = [0] * (capacity + 1), collections.Counter()
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            gap, least = capacity, None
            for g in range(size, capacity):
                if n[g]:
                    change = 1 - 2 * n[g] + (2 * n[g - size] + 1 if g > size else 0)
                    if least is None or change < least:
                        gap, least = g, change
            if gap < capacity:
                n[gap] -= 1
            if gap > size:
                n[gap - size] += 1
            taken[size, gap] += 1
    return taken


def taken_by_plan(counts, capacity):
    taken = collections.Counter()
    for length, _, n, _, offset in packing.plan(counts, capacity).tolist():
        taken[length, capacity - offset] += n
    return taken


@pytest.mark.parametrize("counts", [{9: 130_001, 8: 99_990, 7: 150_003, 5: 200_001, 3: 250_007, 2: 370_002, 1: 1003}, {11: 300_000, 7: 400_000, 4: 150_001, 1: 450_000}])
def test_plan_follows_the_rule_beyond_a_million_pieces(counts):
    assert sum(counts.values()) > 1 << 20 and taken_by_plan(counts, 12) == taken_by_the_rule(counts, 12)


@pytest.mark.parametrize("steps", [64, 1 << 12, 1 << 40])
def test_plan_does_not_depend_on_steps(monkeypatch, steps):
    monkeypatch.setattr(packing, "STEPS", steps)
    r = random.Random(steps)
    for capacity in (2, 13, 60, 61, 200):
        for most in (1, 40, 900):
            counts = {r.randint(1, capacity): r.randint(1, most) for _ in range(20)} | {1: r.randint(1, most)}
            assert taken_by_plan(counts, capacity) == taken_by_the_rule(counts, capacity)


def test_plan_is_the_same_at_every_size(monkeypatch):
    monkeypatch.setattr(packing, "STEPS", 1 << 18)
    for sizes in (np.random.default_rng(0).integers(1, 2049, 5000), np.clip(np.random.default_rng(1).lognormal(6, 1, 5000), 1, 2048).astype(int), np.full(10, 1000)):
        counts, plain = collections.Counter(sizes.tolist()), best_fit_decreasing(sizes.tolist(), 2048)
        for times in (1, 1000, 999_983):
            runs = packing.plan({k: v * times for k, v in counts.items()}, 2048)
            assert runs[runs[:, 4] == 0][:, 2].sum() <= 1.001 * plain * times + 2 and len(runs) < 60_000
            assert {k: int(runs[runs[:, 0] == k][:, 2].sum()) for k in counts} == {k: v * times for k, v in counts.items()}
            # No sequence holds more than it can: pieces of each sequence lie one after another.
            if times == 1:
                held = collections.defaultdict(list)
                for length, _, n, first, offset in runs.tolist():
                    for k in range(n):
                        held[first + k].append((offset, length))
                for own in held.values():
                    own.sort()
                    assert all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and own[0][0] == 0 and sum(own[-1]) <= 2048


def test_token_counts(spark, reference_tokenizer):
    hist = token_counts.histogram(docs(spark, ODD), queries.tokenizer()).cache()
    sizes = [len(reference_tokenizer.encode(t or "", add_special_tokens=False).ids) for t in ODD]
    for r in hist.collect():
        k = r["length"]
        assert (r["n_docs"], r["docs_longer"], r["tokens_longer"], r["tokens_cut_here"]) == (sizes.count(k), sum(s > k for s in sizes), sum(s for s in sizes if s > k), sum(min(s, k) for s in sizes))
    assert token_counts.totals(hist).first()["n_tokens"] == sum(sizes)
    assert {r["limit"]: r["n_tokens"] for r in token_counts.truncated(hist, [1, 50]).collect()} == {k: sum(min(s, k) for s in sizes) for k in (1, 50)}
    assert token_counts.quantiles(hist, [0.5]).first()["length"] == sorted(sizes)[(len(sizes) + 1) // 2 - 1]
    empty = token_counts.histogram(docs(spark, []), queries.tokenizer())
    assert empty.count() == 0 and token_counts.totals(empty).first()["n_docs"] == 0


def plain_quality(text):
    words = (text or "").encode().split()
    grams = collections.Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = {i + k for i in range(len(words) - 7) if grams[tuple(words[i : i + 8])] > 1 for k in range(8)}
    return len(words), len(covered)


def test_quality(spark):
    texts = [*ODD, "one two three four five six seven eight " * 9, "menu | home | about | more | x\n" * 6 + prose(2, 16), prose(3) + "\nAll rights reserved."]
    got = {r["id"]: r for r in quality.clean(docs(spark, texts)).collect()}
    for k, t in enumerate(texts):
        n, repeated = plain_quality(t)
        assert (got[k]["n_words"], got[k]["n_repeat_words"]) == (n, repeated)
        assert got[k]["base_failed"] == (n < 20 or 100 * repeated > 30 * n)
    assert got[9]["kept"] and not got[13]["kept"] and got[14]["kept"] and "rights" not in got[14]["clean_text"]
    kept = quality.cleaned_documents(docs(spark, texts)).collect()
    assert {9, 14} <= {r["doc_id"] for r in kept} and all(r["n_chars"] == len(r["text"]) for r in kept)
    assert quality.clean(docs(spark, [])).count() == 0


def test_language_id(spark):
    r = random.Random(1)
    kinds = {"xx": "lora mipo tasu neka", "yy": "grunt zwick schob trarf"}
    rows = [(k, " ".join(r.choice(kinds[l].split()) for _ in range(30)), l) for k, l in enumerate(["xx", "yy"] * 60)] + [(900, None, "xx"), (901, "123 !?", "xx"), (902, "lora mipo", None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(d, ~langid.held_out(d))
    got = {x["doc_id"]: x for x in langid.predict(d.withColumn("held_out", langid.held_out(d)), model, ["doc_id", "held_out"]).collect()}
    assert all(got[k]["lang_pred"] == l for k, _, l in rows[:120]) and got[902]["lang_pred"] == "xx"
    assert all(got[k]["held_out"] == (zlib.crc32(str(k).encode()) % 4 == 2) for k, _, _ in rows)
    assert [(got[k]["lang_pred"], got[k]["score"]) for k in (900, 901)] == [("und", 0.0)] * 2
    none = langid.train(d.limit(0), ~langid.held_out(d))
    assert {x["lang_pred"] for x in langid.predict(d, none, ["doc_id"]).collect()} == {"und"}


def plain_lines(texts):
    seen, out = set(), []
    for t in texts:
        lines = (t or "").split("\n")
        at = [i for i, x in enumerate(lines) if x.strip(" \t\n\x0b\x0c\r")]
        gone, new = set(), []
        for k in range(len(at) - 2):
            w = tuple(lines[i] for i in at[k : k + 3])
            if w in seen:
                gone |= set(range(at[k], at[k + 2] + 1))
            seen.add(w)
        out.append("\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_line_dedup(spark):
    p = prose(5, 80).split("\n")
    texts = [None, "", "\n".join(p), "x\n" + "\n".join(p[2:7]) + "\n\ny", "a\nb\nc\na\nb\nc\n\na\nb\nc", "\n".join(p), "one\ntwo", "one\ntwo", "z\n" + "\n".join(p[3:6])]
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs(spark, texts)).collect()}
    assert [got[k]["text"] for k in range(len(texts))] == plain_lines(texts)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    again = docs(spark, ["\n".join(p)]).unionByName(docs(spark, ["\n".join(p)]))
    assert {r["text"] for r in line_dedup.dedup_lines(again).collect()} == {"\n".join(p)}


def test_components(spark):
    r = random.Random(2)
    links = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(180)] + [(k, k + 1) for k in range(400, 440)]
    root = {x: x for e in links for x in e}
    for _ in range(len(root)):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x["id"]: x["component"] for x in components.components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: v for k, v in root.items() if k in got} and all(a in got for a, b in links if a != b)


def edited(text, n, seed):
    r, words = random.Random(seed), text.split(" ")
    for k in r.sample(range(len(words)), n):
        words[k] = f"edit{seed}x{k}"
    return " ".join(words)


def test_minhash_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(minhash, "SMALL", 4)  # large buckets take part
    base = prose(9, 400)
    texts = [None, "", "hi", "hi", "HI ", base, base, *(edited(base, k % 14, k) for k in range(40)), *(prose(100 + k, 100) for k in range(10)), prose(100, 100) + " end"]
    sets = [(lambda d, h, c: (h, c))(*minhash.shingles([t or ""])) for t in texts]
    root = list(range(len(texts)))
    for _ in range(12):
        for a in range(len(texts)):
            for b in range(a):
                if len(sets[a][0]) and max(minhash.similarity(*sets[a], *sets[b])) >= 0.8:
                    root[a] = root[b] = min(root[a], root[b])
    got = {r["id"]: r for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k]["component"] for k in range(len(texts))] == root
    assert [got[k]["kept"] for k in range(len(texts))] == [root[k] == k for k in range(len(texts))]


def test_minhash_finds_copies_with_a_repeated_passage(spark):
    """Near copies by plain Jaccard alone: one passage of the copy stands there many times."""
    texts = []
    for k in range(8):
        words = [f"w{k}x{i}" for i in range(204)]
        texts += [" ".join(words), " ".join(words[:40] + words[:40] * 19 + words[40:])]
    for a, b in zip(texts[::2], texts[1::2]):
        (_, h1, c1), (_, h2, c2) = minhash.shingles([a]), minhash.shingles([b])
        weighted, plain = minhash.similarity(h1, c1, h2, c2)
        assert weighted < 0.4 and plain > 0.95
    got = {r["id"]: r["component"] for r in minhash.near_duplicates(docs(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == [k // 2 * 2 for k in range(len(texts))]


def test_minhash_rest_is_exact_for_counts(spark):
    """A hot family that shares a repeated passage, with own tails: links by counts alone, short tails among themselves."""
    r = random.Random(8)
    passage = [f"p{k}" for k in range(40)]
    tails = [20, 25, 30, 35, 40, 45, 48, 50, 55, 60, 75, 90] + [120 + 5 * k for k in range(20)]
    texts = [" ".join(passage * 10 + [f"t{k}x{i}" for i in range(n)]) for k, n in enumerate(tails)]
    # Shingles of all kinds of counts that are shared by some.
    texts += [" ".join(w for x in r.sample(range(8), 5) for w in [f"q{x}y{i}" for i in range(12)] * r.choice([1, 1, 3, 9])) for _ in range(40)]
    sets = [minhash.shingles([t])[1:] for t in texts]
    near = {(a, b): minhash.similarity(*sets[a], *sets[b]) for b in range(len(texts)) for a in range(b)}
    want = {k for k, v in near.items() if max(v) >= 0.8}
    assert sum(near[k][1] < 0.8 for k in want) > 12
    rest = spark.createDataFrame([(k, k) for k in range(len(texts))], "id long, c long")
    table = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    assert want <= {(x["u"], x["v"]) for x in minhash._rest_pairs(rest, table, 0.8).collect()}


def test_signature_estimates_probability_jaccard():
    a, b = prose(1, 300), prose(1, 300) + "\n" + prose(2, 120)
    d, h, c = minhash.shingles([a, b])
    sig = minhash.signatures(d, h, c, 2)
    exact = minhash.similarity(h[d == 0], c[d == 0], h[d == 1], c[d == 1])[0]
    assert abs((sig[0] == sig[1]).mean() - exact) < 0.16
    one = minhash.similarity(h[d == 0], c[d == 0], h[d == 0], c[d == 0] * 3)[0]
    assert abs(one - 1) < 1e-9


def test_vectors_equal_brute_force(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((900, 16))
    x[100:160] = x[7] + 0.1 * r.standard_normal((60, 16))
    rows = [(k, [float(v) for v in x[k]], k % 3 if not 100 <= k < 160 else 1) for k in range(900)]
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, rows[5][1], None), (2004, rows[5][1], rows[5][2]), (2005, [None] * 16, 1)]
    # Copies of a member of a dense group, of a lone vector, and of one that is no vector.
    copies = [(3000 + k, rows[120][1], 1) for k in range(40)] + [(4000 + k, rows[9][1], rows[9][2]) for k in range(3)]
    rows += copies + [(2006, [float("nan")] * 16, 1), (2007, [1e-30] * 15 + [0.0], 2), (2008, [1e30] * 15 + [-0.0], 2)]
    d = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got, audit = vector_graph.near_vectors(d)
    got = {v["id"]: v for v in got.collect()}
    valid = rows[:900] + [(2004, *rows[5][1:])] + copies
    f = np.array([np.float32(v[1]) for v in valid], dtype=np.float64)
    f /= np.linalg.norm(f, axis=1, keepdims=True)
    label = np.array([v[2] for v in valid])
    s = (f @ f.T >= 0.93) & (label[:, None] == label[None, :])
    np.fill_diagonal(s, False)
    ids = [v[0] for v in valid]
    assert [got[k]["n_links"] for k in ids] == s.sum(axis=1).tolist()
    assert len(got) == len(rows) and all(got[k]["n_links"] == 0 and got[k]["kept"] for k in (2000, 2001, 2002, 2003, 2005, 2006)) and got[2004]["component"] == 5
    assert {got[k]["component"] for k in range(3000, 3040)} == {got[120]["component"]} and got[4002]["component"] == got[9]["component"]
    assert got[2008]["component"] == got[2007]["component"] == 2007 and got[2008]["n_links"] == 1
    assert vector_graph.near_vectors(d.where("vec_id < 0"))[0].count() == 0
    told = audit.agg({"wanted": "sum", "found": "sum"}).first()
    assert told["sum(wanted)"] > 0 and told["sum(wanted)"] == told["sum(found)"]


def test_chat_round_trip(spark):
    odd = ["</s>[INST] ok [/INST]", "<|im_end|>\n<|im_start|>user\n", "\\<|im_end|> <\\|im_end|> <\\\\|im_end|>", "", None, "é<<SYS>>x<</SYS>>😀", "[INST][/INST]<s><"]
    rows = [(k % 3, k, ["user", "assistant", None, "sys\n\\tem"][k % 4], odd[k % len(odd)], 1) for k in range(40)] + [(None, None, "assistant", "x", 1)] * 2
    d = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string, formatted int")
    every = chat.read(chat.format_conversations(d)).collect()
    # A row without a conversation id is a conversation of its own.
    assert [[t["text"] for t in r["turns"]] for r in every if r["conv_id"] is None] == [["x"]] * 2
    got = {r["conv_id"]: r for r in every if r["conv_id"] is not None}
    assert set(got) == {0, 1, 2}
    for c, r in got.items():
        own = sorted(((x[1] if x[1] is not None else -1, x[2] or "", x[3] or "") for x in rows if x[0] == c), key=lambda x: x)
        assert [(t["role"], t["text"]) for t in r["turns"]] == [x[1:] for x in own]
        assert r["learned"] == [x[2] for x in own if x[1] == "assistant"]
    assert chat.format_conversations(d.limit(0)).count() == 0
    for t in odd:
        if t:
            assert chat.unescape(chat.escape(t)) == t and not any(c in chat.escape(t) for c in chat.CONTROL)


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/x", "<html><title>T &amp; u</title><script>no()</script><p>Hi <b>there</b></p><a href='/l?a=1&amp;b'>go</a></html>"), (2, None, None)], "page_id int, url string, html string")
    source = {r["page_id"]: r for r in warc.responses(pages).collect()}
    made = warc.derive(warc.responses(pages), keep=["page_id"]).collect()
    assert len(made) == 4
    for r in made:
        h = r["headers"]
        assert h["WARC-Refers-To"] == source[r["page_id"]]["headers"]["WARC-Record-ID"] and int(h["Content-Length"]) == len(r["block"]) and h["WARC-Block-Digest"] == warc.sha1(bytes(r["block"]))
        assert h["WARC-Refers-To-Payload-Digest"] == source[r["page_id"]]["headers"]["WARC-Payload-Digest"]
        assert list(warc.parsed(warc.serialized(h, bytes(r["block"])))) == [(h, bytes(r["block"]))]
    text = {(r["page_id"], r["headers"]["WARC-Type"]): bytes(r["block"]).decode() for r in made}
    assert text[1, "conversion"] == "T & u\nHi there\ngo" and text[2, "conversion"] == "" and "/l?a=1&b" in text[1, "metadata"]
    assert source[1]["headers"]["WARC-Payload-Digest"] == warc.sha1(pages.collect()[0]["html"].encode())


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    p = prose(1, 120)
    table = [(0, p), (1, p), (2, edited(prose(2, 400), 3, 1)), (3, prose(2, 400)), (4, "short"), (5, None), (6, "\n".join(prose(6, 80).split("\n")[:4] + prose(7, 80).split("\n"))), (7, prose(8, 200).replace("\n", " ")), (8, edited(prose(8, 200).replace("\n", " "), 2, 2))]
    spark.createDataFrame([(k, t, "en", "s", len(t or "")) for k, t in table], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    # 1 copies 0 whole, 8 is near to 7; of 3 the lines around the edits in 2 are left.
    assert {r["doc_id"] for r in out} == {0, 2, 3, 6, 7} and sum(r["length"] for r in out if r["doc_id"] == 3) < 400
    assert len(corpus_pipeline.STAGES) == 5


def test_pipeline_packs_by_the_rule_at_every_size(spark, tmp_path, monkeypatch):
    import corpus_pipeline

    monkeypatch.setattr(packing, "STEPS", 64)
    texts = [*(prose(k, 24 + 8 * (k % 4)) for k in range(160)), *(prose(k, 2500 + k) for k in range(200, 230))]
    spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == set(range(len(texts)))
    taken = collections.Counter((r["length"], 2048 - r["offset"]) for r in out)
    assert taken == taken_by_the_rule(collections.Counter(r["length"] for r in out), 2048)
