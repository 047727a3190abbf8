"""Names of the files that make up the extraction datasets."""

from __future__ import annotations

# File names of the triples and categories, in the order of their kinds.
#: Triples for training, without the gold ones.
TRIPLES = (
    "label-train-uniq-raw-rel.db.TRAIN",
    "NELL.08m.165.cesv.csv.CandRel_CBL.out",
    "NELL.08m.165.cesv.csv.CandRel_CPL.out",
    "NELL.08m.165.cesv.csv.CandRel_General.out",
    "NELL.08m.165.cesv.csv.CandRel.out",
    "NELL.08m.165.cesv.csv.CandRel_SEAL.out",
    "NELL.08m.165.cesv.csv.PattRel.out",
    "NELL.08m.165.esv.csv.PromRel_General.out",
    "seed.165.rel.uniq.out",
    "seed.165.rel.uniq_te.out",
    "testTargets.additional.Rel.out",
    "testTargets.additional.ValRel.out",
    "testTargets.shangpu.Rel.out",
    "testTargets.shangpu.ValRel.out",
    "trainTargets.Rel.out",
    "trainTargets.ValRel.out",
    "wlTargets.Rel.out",
)
CATEGORIES = (
    "label-train-uniq-raw-cat.db.TRAIN",
    "NELL.08m.165.cesv.csv.CandCat_CBL.out",
    "NELL.08m.165.cesv.csv.CandCat_CMC.out",
    "NELL.08m.165.cesv.csv.CandCat_CPL.out",
    "NELL.08m.165.cesv.csv.CandCat_General.out",
    "NELL.08m.165.cesv.csv.CandCat_Morph.out",
    "NELL.08m.165.cesv.csv.CandCat.out",
    "NELL.08m.165.cesv.csv.CandCat_SEAL.out",
    "NELL.08m.165.cesv.csv.PattCat.out",
    "NELL.08m.165.esv.csv.PromCat_General.out",
    "seed.165.cat.uniq.out",
    "seed.165.cat.uniq_te.out",
    "testTargets.additional.Cat.out",
    "testTargets.additional.ValCat.out",
    "testTargets.shangpu.Cat.out",
    "trainTargets.Cat.out",
    "wlTargets.Cat.out",
    "testTargets.shangpu.ValCat.out",
    "trainTargets.ValCat.out",
)
#: Gold triples, and gold categories, of the evaluation.
TEST_TRIPLES = ("label-test-uniq-raw-rel.db.TRAIN",)
TEST_CATEGORIES = ("label-test-uniq-raw-cat.db.TRAIN",)

#: Those whose confidences are replaced: the labels and what was extracted; without the labels, those of the strict datasets.
REPLACED_TRIPLES, REPLACED_CATEGORIES = TRIPLES[:8], CATEGORIES[:10]
STRICT_TRIPLES, STRICT_CATEGORIES = TRIPLES[1:8], CATEGORIES[1:10]
