"""The pipeline's five stages together against the same in plain Python."""

import collections
import datetime
import math
import re
import zlib

import numpy as np
import pytest

from orbweave.llm import line_crf, pii
from tests.llm.test_llm import brute_components, feistel, prose

P = pytest.importorskip("public_tokenizers")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, component_id string"
LABELS = "doc_id long, quality int, toxic int"


def plain_score(chain, text):
    """The document's score by forward and backward sums over its lines, one at a time."""
    seen, lines = set(), (text or "").split("\n")
    own = [line_crf.line_features(line, seen) for line in lines]
    none = [0.0] * line_crf.N_OWN
    emit = []
    for i, mine in enumerate(own):
        x = mine + (own[i - 1] if i else none) + (own[i + 1] if i + 1 < len(own) else none)
        emit.append(sum((v - m) / s * w for v, m, s, w in zip(x, chain.mean, chain.scale, chain.weights)))
    add = lambda a, b: max(a, b) + math.log1p(math.exp(-abs(a - b)))
    ahead, back = [(0.0, emit[0])], [(0.0, 0.0)]
    for e in emit[1:]:
        last = ahead[-1]
        ahead.append(tuple((e if y else 0.0) + add(last[0] + chain.moves[0, y], last[1] + chain.moves[1, y]) for y in (0, 1)))
    for e in emit[:0:-1]:
        after = (back[0][0], back[0][1] + e)
        back.insert(0, tuple(add(chain.moves[y, 0] + after[0], chain.moves[y, 1] + after[1]) for y in (0, 1)))
    good = [1 / (1 + math.exp((a[0] + b[0]) - (a[1] + b[1]))) for a, b in zip(ahead, back)]
    long = [max(len(line), 1) for line in lines]
    p = min(max(sum(g * n for g, n in zip(good, long)) / sum(long), 1e-6), 1 - 1e-6)
    return 1 / (1 + math.exp(-(chain.slope * math.log(p / (1 - p)) + chain.shift)))


def plain_lines(rows):
    """Texts by key without the later places of three lines, but for lines of kept places."""
    places = collections.defaultdict(list)
    for key, text in sorted(rows.items()):
        lines = text.split("\n") if text is not None else []
        for i in range(len(lines) - 2):
            if re.search(r"[^\x20\x09-\x0D]", "".join(lines[i : i + 3])):
                places[tuple(lines[i : i + 3])].append((key, i))
    gone, kept = collections.defaultdict(set), collections.defaultdict(set)
    for first, *others in places.values():
        if others:
            kept[first[0]].update(range(first[1], first[1] + 3))
        for key, i in others:
            gone[key].update(range(i, i + 3))
    cut = lambda key, text: "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone[key] - kept[key])
    return {key: cut(key, text) if key in gone else text for key, text in rows.items()}


def plain_pii(text, key):
    """Sixteen digits of a card, social security numbers and days as the fixture writes them."""

    def card(m):
        l, r = feistel(int(m[0][:7]), int(m[0][7:15]), 10**7, 10**8, key, "card")
        body = f"{l:07d}{r:08d}"
        odd = sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(body)))
        return body + str(-odd % 10)

    def ssn(m):
        a, g, s = int(m[1]), int(m[2]), int(m[3])
        l, r = feistel(a - (2 if a > 666 else 1), (g - 1) * 9999 + s - 1, 898, 99 * 9999, key, "ssn")
        return f"{l + (2 if l > 664 else 1):03d}-{r // 9999 + 1:02d}-{r % 9999 + 1:04d}"

    def day(m):
        first = datetime.date.fromisoformat(pii.FIRST_DAY)
        n = (datetime.date.fromisoformat(m[0]) - first).days
        l, r = feistel(n // pii.DAYS_RIGHT, n % pii.DAYS_RIGHT, pii.DAYS_LEFT, pii.DAYS_RIGHT, key, "date")
        return str(first + datetime.timedelta(l * pii.DAYS_RIGHT + r))

    text = re.sub(r"\b\d{16}\b", card, text)
    text = re.sub(r"\b(\d{3})-(\d{2})-(\d{4})\b", ssn, text)
    return re.sub(r"\b\d{4}-\d{2}-\d{2}\b", day, text)


def fixture():
    """(doc_id, text) with bad documents, copies, shared lines and personal values."""
    rng = np.random.default_rng(31)
    page = lambda lines, words=12: "\n".join(prose(rng, words) + "." for _ in range(lines))
    rows = [(i, page(5)) for i in range(40)]
    rows += [(100 + i, "\n".join("a### | $$$ &&" for _ in range(5 + i % 3))) for i in range(40)]
    shared = page(4)
    rows += [(200 + i, page(3) + "\n" + shared + "\n" + page(2)) for i in range(4)]
    base = prose(rng, 150).split()
    for i in range(6):
        words = list(base)
        for k in rng.integers(0, len(words), i):
            words[k] = f"other{k}"
        rows.append((300 + i, " ".join(words) + "."))
    told = "card 4111111111111111 number 123-45-6789 since 1980-02-29."
    rows += [(400, page(3) + "\n" + told + "\n" + page(2)), (401, page(2) + "\n" + told + "\n" + page(3))]
    rows += [(500, None), (501, ""), (502, "one two."), (503, "\n\n\n"), (504, page(1, 3000)), (505, page(300, 8))]
    return [*rows, (0, rows[0][1]), (300, rows[84][1])]  # two rows come twice


def expected(spark, rows, chain):
    good = {(i, t) for i, t in rows if plain_score(chain, t) >= 0.5}
    lines = plain_lines({i: t for i, t in good})
    ids = sorted(lines)
    root, _ = brute_components([lines[i] for i in ids])
    first = [i for k, i in enumerate(ids) if root[k] == k]
    return {i: lines[i] and plain_pii(lines[i], pii.key_of(spark)) for i in first}


def test_pipeline_is_plain_python(spark, tmp_path):
    import corpus_pipeline

    tokenizers = pytest.importorskip("tokenizers")
    rows = fixture()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], SCHEMA)
    labels = spark.createDataFrame([(i, int(i < 100), 0) for i, _ in rows if i < 200], LABELS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    want = expected(spark, rows, line_crf.train(docs, labels))
    # The fixture has what each stage is for.
    assert not any(100 <= i < 140 for i in want) and all(i in want for i in range(40)) and 300 in want and not any(300 < i < 304 for i in want)
    assert len(want[201].split("\n")) == 5 and "4111111111111111" not in want[400] and want[400].split("\n")[3] == want[401].split("\n")[2]

    t = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    by, windows = collections.defaultdict(list), collections.defaultdict(list)
    for r in corpus_pipeline.run(spark, str(tmp_path)).collect():
        assert len(r["ids"]) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        by[r["doc_id"]].append((r["start"], r["ids"]))
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
    ids = {i: [x for _, part in sorted(parts) for x in part] for i, parts in by.items()}
    assert ids == {i: [*t.encode(text or "", add_special_tokens=False).ids, 1] for i, text in want.items()}
    for pieces in windows.values():
        ends = [0, *np.cumsum([n for _, n in sorted(pieces)])]
        assert [o for o, _ in sorted(pieces)] == ends[:-1] and ends[-1] <= 2048


@pytest.mark.parametrize("n", [0, 3])
def test_pipeline_of_nothing(spark, tmp_path, n):
    """No rows give no pieces; rows of nulls alone are whole documents without a text or an id."""
    import corpus_pipeline

    spark.createDataFrame([(None,) * 7] * n, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], LABELS).write.parquet(f"{tmp_path}/labels.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert [(r["doc_id"], r["ids"]) for r in got] == [(None, [1])] * n
