"""The parts of the operators that run inside tasks."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lakeloom.llm import webp
from lakeloom.llm.byte_bpe import Encoder, PerfectHash
from lakeloom.llm.dom import Page, consistent
from lakeloom.llm.license_scan import Template, words_of
from lakeloom.llm.near_dedup import BANDS, ROWS, _Words, estimate, shingle_sets, signature
from lakeloom.llm.token_files import WordEncoder, pack, unpack


@given(st.lists(st.lists(st.integers(0, 2**32 - 1), max_size=40), min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_control_byte_code(docs):
    counts = np.array([len(d) for d in docs])
    coded = pack(np.array([x for d in docs for x in d], dtype=np.uint32), counts)
    assert [len(c) for c in coded[0]] == (-(-counts // 4)).tolist()
    got = unpack(*(np.frombuffer(b"".join(c), dtype=np.uint8) for c in coded), counts)
    assert got.tolist() == [x for d in docs for x in d]


_ENCODER = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
_LIBRARY = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def _same_as_library(texts):
    ids, counts = _ENCODER([t.encode() for t in texts])
    got = [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    assert got == [_LIBRARY.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_are_composed_before_they_are_lower_cased():
    """Capitals and marks that only the small letter composes with, also apart by another mark or before a point."""
    marked = ["J\u030c", "H\u0331", "T\u0308", "W\u030a", "Y\u030a", "J\u0323\u030c", "A\u030a", "\u212a\u0331"]
    _same_as_library([f"x {w}a y" for w in marked] + [f"X{w}. Y{w}, {w} Große ÇA" for w in marked])


def test_special_tokens_are_not_lower_cased():
    _same_as_library(["x <|STARTOFTEXT|> y", "x <|startoftext|> J\u030c", "<|EndOfText|><|endoftext|>", "a<|ENDOFTEXT|>."])


@given(st.lists(st.text(alphabet="JHTWYAßéİΣσſK.,'\u030c\u0331\u0308\u030a\u0323\u0345 \n\u00a01日가", max_size=25), min_size=1, max_size=5))
@settings(max_examples=100, deadline=None)
def test_words_against_the_library(texts):
    _same_as_library(texts)


@given(st.lists(st.text(alphabet="abzAÉé9½.,'-*%_s<|> \n\t\u2019\u00e7\u0416", max_size=30), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_ends_of_words_against_the_library(texts):
    _same_as_library(texts)


def test_texts_without_words_and_long_ones_against_the_library():
    _same_as_library(["", " \n", "a" * 5000 + "." + "é" * 300 + "...", "it's. don't, 'tis' x's! y'll?", "<|endoftext|>", "", "end"])


@given(st.sets(st.binary(max_size=6), max_size=200))
@settings(max_examples=40, deadline=None)
def test_perfect_hash(keys):
    keys = sorted(keys)
    h = PerfectHash(keys)
    assert sorted(h.slot) == list(range(len(keys)))
    assert [h.find(k) for k in keys] == list(range(len(keys))) and h.find(b"not a key") == -1


def test_merges_take_the_lowest_rank_first():
    tokens = [bytes([k]) for k in range(256)] + [b"bc", b"ab", b"abc", b"bcd"]
    e = Encoder(tokens, r"\S+|\s+")
    library = tiktoken.Encoding("t", pat_str=r"\S+|\s+", mergeable_ranks={t: k for k, t in enumerate(tokens)}, special_tokens={})
    for text in ("abcd", "abcx", "bcd", "ababcdbcbcd abcabc", "bbccdd" * 30):
        assert np.frombuffer(e.encode(text), dtype="<u4").tolist() == library.encode_ordinary(text)


@given(st.lists(st.text(alphabet="ab \n\té日", max_size=30), min_size=1, max_size=6), st.integers(1, 3))
@settings(max_examples=60, deadline=None)
def test_shingle_sets(texts, words):
    got = shingle_sets(texts, words, _Words())
    for t, s in zip(texts, got, strict=True):
        w = t.encode().lower().split()
        assert len(s) == len({tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))} if w else set())


def test_estimates_are_near_the_similarity():
    rng = np.random.default_rng(0)
    for common in (0, 300, 600, 900):
        a = rng.integers(1, 2**63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:common], rng.integers(1, 2**63, 1000 - common, dtype=np.uint64)])
        keys, x = signature(np.unique(a))
        assert len(keys) == BANDS and len(x) * 16 == BANDS * ROWS
        assert abs(estimate(x, signature(np.unique(b))[1]) - common / (2000 - common)) < 0.13


def test_templates():
    t = Template("t", "alpha <<beginOptional>>beta gamma<<endOptional>> delta <<var;name=x;words=2>> omega")
    accepts = lambda s: bool(t.spans(w := words_of(s), b" " + b" ".join(w) + b" "))
    assert accepts("x Alpha, delta omega y") and accepts("alpha beta gamma delta one two omega")
    assert not accepts("alpha beta delta omega") and not accepts("alpha delta one two three omega") and not accepts("alpha delta")


@pytest.mark.parametrize(
    "part",
    [
        "<svg/>", '<svg class="i" viewBox="0 0 9 9" />', "<MATH/>", "<svg><path d='M0'/><title/><g><svg/></g></svg>", '<svg href="?a=b"/>',  # closed at once
        "<svg><title>x</title><desc><p>x</p></desc><style>x</style></svg>", "<svg><metadata>x</metadata><script>x</script></svg>",  # nested
        "<select><option>x<option selected>x</select>", "<select><div>x</div></p></article>x</select>",
        "<template><li>x<p>x</template>", "<template><template>x</template></article>x</template>", "<noscript><img src=a>x</article></noscript>",
        "<script>'<select>' + '<svg>'</script>", "<textarea><svg></textarea>", "<style><math></style>", "<!-- <template> -->",  # no tags there
    ],
)
def test_hidden_elements_end_where_html_ends_them(part):
    """The text before and behind them stays, in one line, and they make no nodes."""
    page = Page(f"<article><ul><li>one {part} two</ul><p>three</p></article><p>four")
    assert page.text([True] * len(page.parent)) == "one two\nthree\nfour"
    assert len(page.parent) == len(Page("<article><ul><li>one two</ul><p>three</p></article><p>four").parent)
    page = Page(f"{part}<article><p>three</p></article><p>four {part}")
    assert page.text([True] * len(page.parent)) == "three\nfour"


@pytest.mark.parametrize("part", ["<select><option>x<option>x", "<select>x<select><option>x", "<noscript>", "<template>"])
def test_unclosed_hidden_elements_do_not_take_the_rest(part):
    for behind in ("<p>two</p>three", "<section>two<p>three</section>", "<h2>two</h2><select><option>x</select><svg/>three<noscript>x</noscript><template>x</template>"):
        page = Page(f"<div>one</div><div>{part}{behind}</div>")
        assert page.text([True] * len(page.parent)) == "one\ntwo\nthree"
        page = Page(f"<div>one</div><div>{part}</div>two<p>three")
        assert page.text([True] * len(page.parent)) == "one\ntwo\nthree"


@pytest.mark.parametrize("part", ["<svg><svg><text>x</text></svg><text></text></svg>", "<svg><foreignObject><div>x</div></foreignObject></svg>", "<svg><path>x", "<svg><g><text>x", "<svg class=x/>x", "<span><svg>x</span>", "<video src=a>x</video>", "<canvas>x</canvas>"])
def test_labels_of_drawings_stay_in_their_place(part):
    """Text in drawings and beside media is the page's, makes no nodes in a drawing, and does not take the rest if that is not closed."""
    for behind in ("<p>two</p>three", "<section>two<p>three</section>", "<h2>two</h2><svg/>three<noscript>y</noscript>"):
        page = Page(f"<div>one</div><div>{part}{behind}</div>")
        assert page.text([True] * len(page.parent)).split() == ["one", "x", "two", "three"]


def test_formulas_stay_in_their_line():
    """The text of a formula is the article's, and makes no nodes; one that is not closed does not take the rest."""
    for part in ("<math><mi>x</mi></math>", "<math><mi>x</mi>"):
        page = Page(f"<article><ul><li>one {part} two</ul><p>three</p></article><p>four")
        assert page.text([True] * len(page.parent)).split() == ["one", "x", "two", "three", "four"]
        assert len(page.parent) == len(Page("<article><ul><li>one two</ul><p>three</p></article><p>four").parent)
    assert Page("<p>one <math><mi>x</mi></math> two</p>").text([True] * 2) == "one x two"


def test_hierarchical_choice():
    # the root's child 1 is bad but holds a very good node; child 3 is good and holds a bad one
    parent, odds = [-1, 0, 1, 0, 3], np.array([1.0, -1.0, 3.0, 2.0, -1.0])
    assert consistent(parent, odds) == [True, True, True, True, False]
    assert consistent(parent, np.array([1.0, -4.0, 3.0, 2.0, -1.0])) == [True, False, False, True, False]


# ---- WebP --------------------------------------------------------------------------------------------------------


@given(st.binary(max_size=400), st.sampled_from([1, 7, 40]))
@settings(max_examples=60, deadline=None)
def test_strips_round_trip(raw, times):
    data = np.frombuffer(raw * times + bytes(-len(raw * times) % 64 or 64), dtype=np.uint8).reshape(-1, 64)
    strips = [data[k : k + 64] for k in range(0, len(data), 64)]
    coded = webp.encode_strips(strips)
    assert all((a == b).all() for a, b in zip(webp.decode_strips(coded), strips, strict=True))
    assert webp.encode_strips(strips[:1])[0] == coded[0]
    for a, b in zip(coded, strips, strict=True):
        whole = webp.decode_argb(a)
        assert (whole[..., 0] == 255).all() and all((whole[..., c] == b).all() for c in (1, 2, 3))
    assert webp.webp_images(webp.webp_file([(64, len(s), c) for s, c in zip(strips, coded, strict=True)])) == coded


class _Writer(webp._Out):
    """Writes any VP8L image literally: forward transforms are given by the test."""

    def image(self, argb, main, cache_bits=0, copies=()):
        """Literals, cache hits where the cache holds the pixel, and copies {place: (length, distance code)}."""
        self.put(1 if cache_bits else 0, 1)
        if cache_bits:
            self.put(cache_bits, 4)
        if main:
            self.put(0, 1)
        copies, cache, items, at = dict(copies), {}, [], 0
        while at < len(argb):
            n = 1
            p = int(argb[at])
            slot = (0x1E35A7BD * p & 0xFFFFFFFF) >> (32 - cache_bits) if cache_bits else None
            if at in copies:
                n, far = copies[at]
                items.append(("copy", n, far))
            elif cache_bits and cache.get(slot) == p:
                items.append(("hit", slot, 0))
            else:
                items.append(("pixel", p, 0))
            for q in argb[at : at + n].tolist():
                if cache_bits:
                    cache[(0x1E35A7BD * q & 0xFFFFFFFF) >> (32 - cache_bits)] = q
            at += n
        one = lambda v: tuple(int(x[0]) for x in webp._prefix(np.array([v])))
        symbols = [[], [], [], [], []]
        for kind, a, b in items:
            if kind == "pixel":
                for c, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    symbols[c].append(a >> s & 255)
            elif kind == "hit":
                symbols[0].append(280 + a)
            else:
                symbols[0].append(256 + one(a)[0])
                symbols[4].append(one(b)[0])
        sizes = (280 + (1 << cache_bits if cache_bits else 0), 256, 256, 256, 40)
        lengths, values = [], []
        for own, size in zip(symbols, sizes, strict=True):
            n = webp.code_lengths(np.bincount(own, minlength=size).tolist(), 15) if own else [0] * size
            if sum(map(bool, n)) == 1 and n.index(1) > 255:
                n[0] = 1  # a second symbol, so that the code can be written
            self.code(n)
            values.append(webp.codes(np.array([n]))[0].tolist())
            lengths.append(n if sum(map(bool, n)) > 1 else [0] * size)
        put = lambda c, s: self.put(values[c][s], lengths[c][s])
        for kind, a, b in items:
            if kind == "pixel":
                for c, s in ((0, 8), (1, 16), (2, 0), (3, 24)):
                    put(c, a >> s & 255)
            elif kind == "hit":
                put(0, 280 + a)
            else:
                for c, base, v in ((0, 256, a), (4, 0, b)):
                    code, extra, n = one(v)
                    put(c, base + code)
                    self.put(extra, n)

    def done(self):
        return self.value.to_bytes((self.n + 7) // 8, "little")


def _head(width, height):
    o = _Writer()
    o.put(0x2F, 8), o.put(width - 1, 14), o.put(height - 1, 14), o.put(1, 1), o.put(0, 3)
    return o


def _random(n, colours=None, seed=0):
    rng = np.random.default_rng(seed)
    c = rng.integers(0, 2**32, n if colours is None else colours, dtype=np.int64)
    return c if colours is None else c[rng.integers(0, colours, n)]


def test_cache_and_copies():
    argb = _random(400, 30)
    argb[200:260] = argb[100:160]  # 100 back
    for k in range(300, 340):
        argb[k] = argb[k - 20]  # one row of 20 above: distance code 1
    o = _head(20, 20)
    o.put(0, 1)
    o.image(argb, True, cache_bits=5, copies={200: (60, 100 + 120), 300: (40, 1)})
    assert (webp.decode_argb(o.done()).reshape(-1, 4) == webp._channels(argb)).all()


@pytest.mark.parametrize("mode", range(14))
def test_predictor_modes(mode):
    """The residual of every pixel against the prediction from its neighbours, written out independently."""
    w, h = 9, 7
    px = webp._channels(_random(w * h, seed=mode)).reshape(h, w, 4).astype(int)
    half = lambda a, b: (a + b) // 2
    residual = np.zeros_like(px)
    for y in range(h):
        for x in range(w):
            if y == 0:
                p = px[0, x - 1] if x else np.array([255, 0, 0, 0])
            elif x == 0:
                p = px[y - 1, 0]
            else:
                L, T, TL = px[y, x - 1], px[y - 1, x], px[y - 1, x - 1]
                TR = px[y - 1, x + 1] if x + 1 < w else px[y, 0]
                grad, mean = L + T - TL, half(L, T)
                near_left = np.abs(grad - L).sum() < np.abs(grad - T).sum()
                p = [np.array([255, 0, 0, 0]), L, T, TR, TL, half(half(L, TR), T), half(L, TL), mean, half(TL, T), half(T, TR), half(half(L, TL), half(T, TR)), L if near_left else T, np.clip(grad, 0, 255), np.clip(mean + np.trunc((mean - TL) / 2).astype(int), 0, 255)][mode]
            residual[y, x] = (px[y, x] - p) & 255
    o = _head(w, h)
    o.put(1, 1), o.put(webp.PREDICTOR, 2), o.put(0, 3)
    o.image(np.full(3 * 2, 255 << 24 | mode << 8), False)
    o.put(0, 1)
    o.image(webp._packed(residual).reshape(-1), True)
    assert (webp.decode_argb(o.done()) == px).all()


def test_cross_colour_and_green():
    w, h = 8, 8
    px = webp._channels(_random(w * h, seed=5)).reshape(h, w, 4).astype(int)
    sign = lambda v: (v & 255) - 256 * ((v & 255) > 127)
    red_to_blue, green_to_blue, green_to_red = -20, 35, -77
    coded = px.copy()
    coded[..., 1] = px[..., 1] - (green_to_red * sign(px[..., 2]) >> 5)
    coded[..., 3] = px[..., 3] - (green_to_blue * sign(px[..., 2]) >> 5) - (red_to_blue * sign(px[..., 1]) >> 5)
    coded &= 255
    coded[..., 1] = (coded[..., 1] - coded[..., 2]) & 255
    coded[..., 3] = (coded[..., 3] - coded[..., 2]) & 255
    o = _head(w, h)
    o.put(1, 1), o.put(webp.CROSS, 2), o.put(0, 3)
    o.image(np.full(4, 255 << 24 | (red_to_blue & 255) << 16 | (green_to_blue & 255) << 8 | green_to_red & 255), False)
    o.put(1, 1), o.put(webp.GREEN, 2), o.put(0, 1)
    o.image(webp._packed(coded).reshape(-1), True)
    assert (webp.decode_argb(o.done()) == px).all()


@pytest.mark.parametrize("colours", [1, 2, 4, 5, 16, 17, 200])
def test_palettes(colours):
    w, h = 13, 6
    table = _random(colours, seed=colours)
    index = np.random.default_rng(1).integers(0, colours, (h, w))
    bundle = webp._bundle(colours)
    each = 8 >> bundle
    padded = np.zeros((h, webp._blocks(w, bundle) << bundle), dtype=np.int64)
    padded[:, :w] = index
    packed = (padded.reshape(h, -1, 1 << bundle) << (np.arange(1 << bundle) * each)).sum(axis=2)
    o = _head(w, h)
    o.put(1, 1), o.put(webp.PALETTE, 2), o.put(colours - 1, 8)
    o.image(webp._packed(np.diff(webp._channels(table), axis=0, prepend=0)), False)
    o.put(0, 1)
    o.image(255 << 24 | packed.reshape(-1) << 8, True)
    assert (webp.decode_argb(o.done()) == webp._channels(table[index])).all()
