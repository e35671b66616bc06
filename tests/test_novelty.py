"""Classes of transcripts against a gene made for this test, derived by hand, on both strands.

The gene has five exons; its isoforms differ in the start of the second, the end of the third, the start of the fourth, and one leaves
out the second and third.
"""

import pytest

from spliceforge.operators.novelty import Reference

FULL = [(100, 150), (220, 260), (330, 380), (450, 500), (600, 680)]


def changed(chain, **by_place):
    """``chain`` with single exons put in place of others (e1 is the first)."""
    return [by_place.get(f"e{i + 1}", e) for i, e in enumerate(chain)]


GENE = [FULL, [(90, 150), (450, 500), (600, 650)], changed(FULL, e2=(240, 260)), changed(FULL, e3=(330, 390)), changed(FULL, e4=(460, 500))]
CASES = [
    (0, "FSM", changed(FULL, e1=(110, 150), e5=(600, 640))),
    (1, "5' fragment", [(225, 260), *FULL[2:]]),
    (1, "3' fragment", [*FULL[:2], (330, 370)]),
    (1, "mono-exon", [(340, 370)]),
    (1, "novel exonic TSS", [(300, 380), *FULL[3:]]),
    (1, "novel exonic PAS", [*FULL[:2], (330, 420)]),
    (2, "exon skipping", [FULL[0], *FULL[2:]]),
    (2, "intron retention", [FULL[0], (220, 380), *FULL[3:]]),
    (2, "novel combination", changed(FULL, e2=(240, 260), e3=(330, 390))),
    (2, "novel junction", changed(FULL, e3=(330, 390), e4=(460, 500))),
    (3, "novel 5' splice site", changed(FULL, e1=(100, 160))),
    (3, "novel 3' splice site", changed(FULL, e2=(210, 260))),
    (3, "novel exon", [*FULL[:3], (410, 430), *FULL[3:]]),
    (3, "novel intronic TSS", [(410, 430), *FULL[3:]]),
    (3, "novel intronic PAS", [*FULL[:3], (540, 570)]),
]
ENDS = {"5'": "3'", "TSS": "PAS"}
ENDS |= {b: a for a, b in ENDS.items()}


def mirrored(chain):
    return [(1000 - b, 1000 - a) for a, b in reversed(chain)]


def swapped(name):
    return " ".join(ENDS.get(w, w) for w in name.split())


@pytest.mark.parametrize("category,name,exons", CASES, ids=[c[1] for c in CASES])
def test_class(category, name, exons):
    got, subs = Reference(GENE, "+").classify(exons)
    assert (got, name in subs) == (category, True), subs
    same, mirror = Reference([mirrored(c) for c in GENE], "-").classify(mirrored(exons))
    assert (same, set(mirror)) == (category, set(subs))
    # the same place read on the other strand
    assert set(Reference(GENE, "-").classify(exons)[1]) == {swapped(s) for s in subs}


def test_places_of_what_is_new():
    ref = Reference(GENE, "+")
    assert ref.classify(changed(FULL, e1=(100, 160)))[1] == {"novel 5' splice site": [(160, -10)]}
    assert ref.classify([FULL[0], *FULL[2:]])[1]["exon skipping"] == [(220, 260), (240, 260)]
    assert ref.classify([FULL[0], (220, 380), *FULL[3:]])[1]["intron retention"] == [(260, 330)]


def test_readthrough_is_the_highest_category():
    category, subs = Reference(GENE, "+").classify([*FULL[:2], (900, 950)], fused=frozenset({2}))
    assert category == 4 and subs["readthrough fusion"] == [2]
