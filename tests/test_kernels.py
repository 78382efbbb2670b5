import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from palimpsest.config import AlignConfig, FingerprintConfig
from palimpsest.functions import kernels as k
from tests import brute

WORDS = ("reed bank tide silt marsh heron " * 3 + "the river carries fine clay towards a slow estuary where salt meets fresh water and plants hold the mud").split()


def test_known_hash_values():
    assert k.word_value("decomposition") == 712203369825161900
    assert k.shingles("decomposition slows almost to a".split(), 5).tolist() == [27369917204651167]
    a, b = k.permutations(128, 20240101)
    assert (int(a[0]), int(b[0])) == (1053531778948016328, 919654134063403363)
    assert (int(a[127]), int(b[127])) == (1991699446498247426, 1016672264994416566)


@given(st.lists(st.sampled_from(WORDS), max_size=40), st.integers(0, 7))
@settings(max_examples=60, deadline=None)
def test_shingles_match_their_definition(words, n):
    assert k.shingles(words, n).tolist() == brute.shingles(words, n)


@given(st.lists(st.integers(0, 5), max_size=30), st.integers(0, 6))
@settings(max_examples=200, deadline=None)
def test_winnow_takes_the_rightmost_minimum(h, w):
    assert k.winnow(np.array(h, np.uint64), w).tolist() == brute.winnow(h, w)


def test_minhash_is_exact_and_marks_empty_sets():
    rng = random.Random(1)
    values = [rng.randrange(2**61 - 1) for _ in range(50)] + [0, 2**61 - 2]
    assert k.minhash(np.array(values, np.int64), 128, 20240101).tolist() == brute.minhash(values, 128, 20240101)
    assert set(k.minhash(np.empty(0, np.int64), 128, 20240101).tolist()) == {2**61 - 1}


def test_a_shared_run_of_the_guaranteed_length_shares_a_value():
    cfg = FingerprintConfig()
    a, b = "one two three four".split() + WORDS[20:28] + "five six seven".split(), "alpha beta".split() + WORDS[20:28] + "gamma delta".split()
    assert cfg.guaranteed_match_length == 8
    assert set(k.fingerprint(a, cfg)[1]) & set(k.fingerprint(b, cfg)[1])


def test_an_inserted_word_keeps_most_fingerprints():
    words = [f"w{i * 7 % 113}" for i in range(115)]
    a, b = (set(k.fingerprint(x, FingerprintConfig())[1].tolist()) for x in (words, words[:50] + ["new"] + words[50:]))
    assert len(a & b) / len(a) > 0.85


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14))
@settings(max_examples=300, deadline=None)
def test_alignment_equals_the_cell_by_cell_one(a, b):
    got = k.smith_waterman(np.array(a, np.int64), np.array(b, np.int64), AlignConfig())
    want = brute.local_alignment(a, b)
    assert got[:4] == want[:4] and got[4] == pytest.approx(want[4])


@given(st.lists(st.integers(0, 2), max_size=30), st.lists(st.integers(0, 2), max_size=30))
@settings(max_examples=200, deadline=None)
def test_long_regions_are_aligned_alike(a, b):
    x, y = np.array(a, np.int64), np.array(b, np.int64)
    if len(a) and len(b):
        assert k._score_long(x, y, AlignConfig()) == pytest.approx(brute.local_alignment(a, b))


def test_regions_of_all_sizes_together(monkeypatch):
    rng = random.Random(5)
    regions = [(np.array([rng.randrange(3) for _ in range(rng.randrange(12))]), np.array([rng.randrange(3) for _ in range(rng.randrange(12))])) for _ in range(60)]
    want = [pytest.approx(brute.local_alignment(a.tolist(), b.tolist())) for a, b in regions]
    for cells in (20, 60, 10_000):
        monkeypatch.setattr(k, "CELLS", cells)
        assert k.local_alignments(regions, AlignConfig()) == want


@given(st.lists(st.sampled_from(["References", "\n", "\n", "  ", "x", ":", " works cited", "bibliography", ". "]), max_size=12))
@settings(max_examples=300, deadline=None)
def test_reference_heading_is_the_last_line_of_its_kind(parts):
    import re

    text = "".join(parts)
    slow = [m.start() for m in re.finditer(r"^\s*(?:references|bibliography|works\s+cited|literature\s+cited)\s*:?\s*$", text, re.I | re.M)]
    assert k._references(text) == (slow[-1] if slow else None)


def test_chains_drift_and_break():
    assert k.chains([(0, 10), (4, 14), (9, 20), (40, 50)], 12) == [[0, 9, 10, 20, 3], [40, 40, 50, 50, 1]]
    assert k.chains([], 12) == []


def test_merge_keeps_the_stronger_of_two_overlapping_passages():
    assert k.merge_claims([(0, 20, 0, 20, 1.0), (5, 18, 5, 18, 1.0), (30, 40, 2, 12, 0.9)]) == [(0, 20, 0, 20, 1.0), (30, 40, 2, 12, 0.9)]


def test_fold_keeps_offsets_through_expansions_and_deletions():
    text, at = k.fold("a​bﬁn😀é")
    assert text == "abfin😀e"
    assert at.tolist() == [0, 2, 3, 3, 4, 5, 6]


def test_normalize_joins_broken_words_and_points_into_the_raw_text():
    raw = "Fine know-\n  ledge stays. Smith et al. agree, as Dr. Who says. End"
    n = k.normalize(raw)
    assert n.words[:3] == ["fine", "knowledge", "stays"]
    assert [raw[s:e] for s, e in n.spans][0] == "Fine"
    assert len(n.sentences) == 3
    assert k.normalize("").words == []


@pytest.mark.parametrize("text,kinds", [
    ("As (Smith, 2019) and (Smith & Jones, 2019) say [3, 5-7].", ["citation"] * 3),
    ("Not (Smith 2019) nor (Smith et al., 2019).", []),
    ('He said "this is long enough" twice.', ["quote"]),
    ("Text.\n\nReferences\nA. Book.", ["bibliography"]),
    ("    an indented block quotation of some length", ["quote"]),
])
def test_exclusions(text, kinds):
    assert [x[2] for x in k.normalize(text).exclusions] == kinds


def test_evasion_by_look_alikes_is_folded_away():
    assert k.normalize("the r​iver сarries").words == ["the", "river", "carries"]


def test_style_features_are_bounded_and_zero_for_nothing():
    f = k.style(k.normalize("The bank rose. However, the bank fell again; and the tide moved on."))
    assert f["discourse_marker_rate"] == pytest.approx(1 / 13) and 0 < f["type_token_ratio"] <= 1 and f["sent_len_mean"] == 6.5
    assert set(k.style(k.normalize("")).values()) == {0.0}


def test_isotonic_fit_never_falls():
    ends, values = k.isotonic_fit([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], [0, 1, 0, 1, 0, 1])
    assert values == sorted(values) and ends == sorted(ends) and len(values) < 6
    assert k.isotonic_fit([], []) == ([], [])


def test_masking_is_repeatable_and_refill_puts_words_back():
    text = "one two three four five six seven eight nine ten"
    masked, n = k.mask_spans(text, 0.3, 2, 4)
    assert n >= 1 and (masked, n) == k.mask_spans(text, 0.3, 2, 4) and masked.count("<extra_id_") == n
    assert k.mask_spans("a b") == ("a b", 0)
    assert k.refill("a <extra_id_0> b <extra_id_1> c", "<extra_id_0> x y <extra_id_2> z") == "a x y b c"


def test_query_phrases_do_not_overlap():
    p = k.query_phrases([f"content{i}" if i % 3 else "the" for i in range(50)])
    assert len(p) == 6 and all(len(x.split()) == 6 for x in p)
    assert k.query_phrases(["short", "text"]) == ["short text"] and k.query_phrases([]) == []


class Toy:
    def token_logprobs(self, text):
        return [(w, -float(len(w)), float(len(w) % 3)) for w in text.split()]

    def perturb(self, text):
        return k.drop_words(text)


def test_likelihood_features_with_a_stub_model():
    text = "a bb ccc dddd. eeeee ffffff ggggggg hhhhhhhh. " * 3
    n = k.normalize(text)
    f = k.likelihood(n.text, Toy(), n.sentences)
    assert f["burstiness"] > 0 and f["mean_log_prob"] < 0
    assert k.likelihood("", Toy(), []) is None


def test_loaders():
    import io
    import zipfile

    assert k.decode("é".encode()) == "é" and k.decode(b"caf\xe9s") == "cafés"
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>One</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    z = io.BytesIO()
    with zipfile.ZipFile(z, "w") as f:
        f.writestr("word/document.xml", xml)
    assert k.docx_text(z.getvalue()) == "One\na\tb"
    rtf = r"{\rtf1{\fonttbl{\f0 Arial;}}Hello\par caf\'e9 " + chr(92) + "u8211?}"
    assert k.rtf_text(rtf).split() == ["Hello", "café", "–"]
    assert k.html_text("<p>a</p><script>x</script>b").split() == ["a", "b"]


def test_highlight_escapes_and_skips_nested_marks():
    assert k.highlight("a<b cd", [(0, 3, "match", "x"), (1, 2, "match", "y")]) == '<mark class="match" title="x">a&lt;b</mark> cd'
