import base64
import math
import random
import re
from collections import Counter

import public_tokenizers
import sentencepiece
import tiktoken

from tests.llm.data import awkward, empty
from tillroll.llm import fertility
from tillroll.llm.queries import PIECE_VOCABULARY, SECOND_VOCABULARY


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    covered = {k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    repeated = sum(line in lines[:k] for k, line in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), repeated, len(covered)


def test_base_measures_against_brute_force(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice(["a ", "b ", "é\n", "##<", " \n", " ", "\x85 ", "\x1f"]) for _ in range(rng.randint(0, 150))) for _ in range(60)]
    docs = awkward(spark, texts)
    got = {r.doc_id: r for r in fertility.measure(docs, PIECE_VOCABULARY, ["doc_id", "score"]).collect()}
    for k, text in enumerate(texts):
        r = got[100 + k]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == plain(text)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)
    assert got[1].n_words == 0 and got[1].token_entropy is None and not got[1].kept
    assert got[4].n_words == 30000
    assert fertility.measure(empty(spark), PIECE_VOCABULARY, ["doc_id"]).count() == 0


def test_tokens_are_those_of_the_library():
    meter = fertility.Meter(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    whole = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    text = "Some plain words, naïve ones and 漢字 \U0001f600 too"
    (tokens,) = meter.tokens([text.encode().split()])
    assert tokens.tolist() == whole.encode(text)
    assert meter.is_byte[tokens].sum() == sum(whole.is_byte(k) for k in whole.encode(text)) > 0


def test_bands():
    assert fertility.script_of("plain text".encode()) == "latin" and fertility.script_of("русский".encode()) == "cyrillic"
    assert fertility.script_of("漢字かな".encode()) == "cjk" and fertility.script_of(b"123 !") == "other"
    band = fertility.BANDS["latin"]
    assert fertility.within(band, 4.0, 0.0, 6.0)
    assert not fertility.within(band, 1.0, 0.0, 6.0) and not fertility.within(band, 4.0, 0.5, 6.0) and not fertility.within(band, 4.0, 0.0, 1.0)


def test_unreadable_text_is_rejected(spark):
    rng = random.Random(1)
    noise = " ".join("".join(chr(rng.randint(0x1F300, 0x1F5FF)) if rng.random() < 0.3 else rng.choice("abc") for _ in range(6)) for _ in range(200))
    row = fertility.measure(awkward(spark, [noise]), PIECE_VOCABULARY, ["doc_id"]).filter("doc_id = 100").first()
    assert not row.base_failed and not row.kept and row.byte_share > 0.1


def _words(rng, letters, n=300):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(2, 9))) for _ in range(n))


def test_noise_is_rejected_and_prose_kept(spark):
    rng = random.Random(3)
    noise = [_words(rng, "abcdefghijklmnopqrstuvwxyz") for _ in range(20)]
    noise += [" ".join(base64.b64encode(rng.randbytes(45)).decode() for _ in range(80)) for _ in range(20)]
    noise += [" ".join(rng.randbytes(16).hex() for _ in range(80)) for _ in range(20)]
    noise += [_words(rng, [chr(c) for c in range(0x430, 0x450)]) for _ in range(20)]
    wrong = "Слова этого текста прочитали в чужой кодировке, и теперь никто не понимает их смысла. " * 3
    noise += [" ".join(f"{w}{k}" for k, w in enumerate(wrong.encode().decode("latin-1").split())) + " x" * 20]
    english = "The harbour was quiet that morning, and the fishermen mended their nets while gulls circled above the old stone pier. Nobody spoke of the storm, although broken masts still lay along the beach and the lighthouse keeper had not been seen for days. By noon a small boat arrived with letters, flour and two crates of oranges from the mainland."
    vietnamese = "Buổi sáng hôm ấy bến cảng rất yên tĩnh, những người đánh cá ngồi vá lưới trong khi chim bay vòng trên cầu đá cũ. Không ai nhắc đến cơn bão, dù những cột buồm gãy vẫn nằm dọc bãi biển và người giữ ngọn hải đăng đã mấy ngày không thấy đâu. Đến trưa một chiếc thuyền nhỏ mang thư, bột mì và hai thùng cam từ đất liền tới."
    russian = "Утром в гавани было тихо, рыбаки чинили сети, а чайки кружили над старым каменным причалом. Никто не говорил о буре, хотя сломанные мачты ещё лежали вдоль берега, а смотрителя маяка не видели уже несколько дней. К полудню пришла небольшая лодка с письмами, мукой и двумя ящиками апельсинов с материка, и люди медленно вышли из домов, чтобы встретить её и узнать последние новости."
    prose = [english, vietnamese, russian]
    docs = awkward(spark, noise + prose)
    found = {r.doc_id: r for r in fertility.measure(docs, PIECE_VOCABULARY, ["doc_id"], second=SECOND_VOCABULARY).collect()}
    for k in range(len(noise)):
        assert not found[100 + k].base_failed and not found[100 + k].kept, found[100 + k]
    for k in range(len(prose)):
        assert found[100 + len(noise) + k].kept, found[100 + len(noise) + k]


def test_measures_against_the_libraries(spark):
    rng = random.Random(5)
    texts = [_words(rng, "abcdeé漢😀#1", rng.randint(1, 60)) for _ in range(20)] + ["a" * 2500 + " b"]
    pieces = sentencepiece.SentencePieceProcessor(model_file=PIECE_VOCABULARY)
    path, pattern = SECOND_VOCABULARY
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    other = tiktoken.Encoding("other", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    rows = fertility.measure(awkward(spark, texts), PIECE_VOCABULARY, ["doc_id"], second=SECOND_VOCABULARY)
    found = {r.doc_id: r for r in rows.collect()}
    for k, text in enumerate(texts):
        r, chars = found[100 + k], len(text.replace(" ", ""))
        tokens = [t for w in text.split() for t in pieces.encode(w)]
        share = [n / len(tokens) for n in Counter(tokens).values()]
        assert r.n_tokens == len(tokens) and math.isclose(r.chars_per_token, chars / len(tokens))
        assert math.isclose(r.byte_share, sum(pieces.is_byte(t) for t in tokens) / len(tokens), abs_tol=1e-12)
        assert math.isclose(r.token_entropy, -sum(p * math.log2(p) for p in share), abs_tol=1e-9)
        cut = [(" " + w)[a : a + fertility.PIECE] for w in text.split() for a in range(0, len(w) + 1, fertility.PIECE)]
        assert math.isclose(r.second_chars_per_token, chars / sum(len(other.encode_ordinary(c)) for c in cut))
    assert found[1].second_chars_per_token is None


def test_one_long_run_is_measured_whole_and_soon():
    counter = fertility.Counter(open(SECOND_VOCABULARY[0], "rb").read(), SECOND_VOCABULARY[1])
    runs = [b"a" * 1_000_000, b"0123456789abcdef" * 62_500, "漢字".encode() * 160_000]
    assert all(counter.count([run]) > 10_000 for run in runs)
