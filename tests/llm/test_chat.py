import hashlib
import random
import re
from collections import defaultdict

from laneprice.llm.chat import BUDGET, format_windows, parse_window, read_back


def rows(rng):
    out, pieces = [], ["</s>", "[INST]", "\\", "[/INST]", "<s>", "<", "[", "/s>", "é", "\n", "word ", "\U0001f600", "$1"]
    for conv in [None, *range(30)]:
        n = rng.randrange(1, 30)
        for t in range(n):
            role = "system" if t == 0 and rng.random() < 0.5 else rng.choice(["user", "assistant", "assistant", "tool\nx\\", None])
            text = rng.choice([None, "", "".join(rng.choices(pieces, k=rng.randrange(900)))])
            out.append((conv, t, role, text))
    return out + [(5, None, "user", "no turn"), (-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def test_reads_back_what_went_in(spark):
    turns = rows(random.Random(7))
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, window int")
    windows = format_windows(df)
    by = defaultdict(list)
    for c, t, role, text in turns:
        by[c].append((-1 if t is None else t, role or "", text or ""))
    sizes = defaultdict(int)
    for w in windows.collect():
        sizes[w.conv_id] += len(w.formatted)
        first = sorted(by[w.conv_id], key=lambda t: (t[0], t[1].encode(), t[2].encode()))[0]
        assert first[1] != "system" or parse_window(w.formatted)[0] == first[1:]
    got = {r.conv_id: r for r in read_back(windows).collect()}
    assert set(got) == set(by)
    for c, own in by.items():
        own.sort(key=lambda t: (t[0], t[1].encode(), t[2].encode()))
        loss = "".join(t for _, r, t in own if r == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        assert tuple(got[c])[1:] == (len(own), sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), sha(loss), sizes[c])
    assert read_back(format_windows(df.limit(0))).collect() == []


def test_windows_repeat_history_and_mask_it(spark):
    turns = [(1, 0, "system", "be kind")] + [(1, t, "assistant" if t % 2 == 0 else "user", f"t{t} " + "x" * (4 * BUDGET if t == 9 else 300)) for t in range(1, 60)]
    got = format_windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).orderBy("window").collect()
    assert len(got) > 3
    seen = 0
    for k, w in enumerate(got):
        own = parse_window(w.formatted)
        assert own[0] == ("system", "be kind") and (w.n_repeated > 0) == (k > 0)
        seen += len(own) - w.n_repeated
        fresh = [t for r, t in own[w.n_repeated :] if r == "assistant"]
        assert [w.formatted[s.start : s.end] for s in w.loss_spans] == fresh
    assert seen == len(turns) and any(w.n_repeated > 1 for w in got)


def test_windows_keep_to_the_budget_and_are_full(spark):
    rng = random.Random(11)
    turns = [(0, t, "assistant", "a" * 3600) for t in range(2)]
    for c in range(1, 12):
        turns += [(c, t, "system" if t == 0 and c % 2 else rng.choice(["user", "assistant"]), "\\</s>" * rng.choice([5, 40, 150, 700])) for t in range(40)]
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    paths = [None]
    try:
        import public_tokenizers
        from tokenizers import Tokenizer

        paths.append(public_tokenizers.path("word_bpe_49k.json"))
    except ImportError:
        pass
    for path in paths:
        counter = Tokenizer.from_file(path) if path else None
        size = lambda s: len(counter.encode(s, add_special_tokens=False).ids) if counter else -(-len(s.encode()) // 4) + 4
        windows = defaultdict(list)
        for w in format_windows(df, tokenizer_path=path).orderBy("conv_id", "window").collect():
            own = [size(t) for t in re.findall(r"<s>.*?</s>|\[INST\].*?\[/INST\]", w.formatted, re.S)]
            assert w.n_tokens == sum(own)
            windows[w.conv_id].append((own, w.n_repeated))
        assert path or len(windows[0]) == 2
        for conv, mine in windows.items():
            for own, repeated in mine:
                assert sum(own) <= BUDGET or (len(own) - repeated == 1 and repeated <= conv % 2)
            for (own, _), (after, repeated) in zip(mine, mine[1:]):
                assert sum(own) + after[repeated] > BUDGET
