"""A synthetic collection of all three kinds of source, for tests and the smoke run."""

from __future__ import annotations

import csv
import os

import numpy as np

from ..functions.images import encode_png
from ..labels import SOURCE_LABELS


def picture(seed: int, side: int = 24, kind: int | None = None) -> np.ndarray:
    """Coloured blocks; those of one ``kind`` share a tint, so that a model can learn it."""
    rng = np.random.default_rng(seed)
    coarse = rng.integers(0, 255, (6, 6, 3))
    if kind is not None:
        coarse = (coarse * 0.15 + np.random.default_rng(10**6 + kind).integers(0, 255, 3) * 0.85).astype(np.int64)
    return np.kron(coarse, np.ones((side // 6, side // 6, 1))).astype(np.uint8)


def _put(path: str, data: bytes) -> None:
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def make_sources(root: str, leaves: int = 6, seed: int = 0, tinted: bool = False) -> int:
    """Write three sources below ``root`` and return the number of labelled pictures.

    Every source label has ``leaves`` leaves with two views each, the second
    mirrored. Beside them lie one picture of a test set, one broken file, the
    one-hot table and groups.csv, the reviewed group of each leaf.
    """
    reviewed, hot = [], []
    kinds = sorted({label for names in SOURCE_LABELS.values() for label in names.values()})
    for source, names in SOURCE_LABELS.items():
        for k, (name, label) in enumerate(names.items()):
            for leaf in range(leaves):
                seed += 1
                rgb = picture(seed, kind=kinds.index(label) if tinted else None)
                for view, pixels in enumerate((rgb, rgb[:, ::-1])):
                    file = f"Train_{len(hot)}.png" if source == "cornell" else f"{k}_{leaf}_{view}.png"
                    folder = "images" if source == "cornell" else name
                    _put(f"{root}/{source}/{folder}/{file}", encode_png(np.ascontiguousarray(pixels)))
                    reviewed.append((source, f"{folder}/{file}", f"{source}-{k}-{leaf}"))
                    if source == "cornell":
                        hot.append((file[:-4], *(int(c == name) for c in names)))
    _put(f"{root}/cornell/images/Test_0.png", encode_png(picture(9999)))
    _put(f"{root}/plantvillage/Apple___healthy/broken.png", b"no picture")
    with open(f"{root}/cornell/train.csv", "w", encoding="utf-8") as f:
        csv.writer(f).writerows([("image_id", *SOURCE_LABELS["cornell"]), *hot])
    with open(f"{root}/groups.csv", "w", encoding="utf-8") as f:
        csv.writer(f).writerows([("source_dataset", "image_path", "group_id"), *reviewed])
    return len(reviewed)
