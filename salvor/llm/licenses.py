"""License scans: MinHash bands over text windows, then exact shingle containment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from salvor.llm.words import Words, bounds_of, lower_ascii, mix, pieces, windows, words_of

SHINGLE, CONTAINMENT = 5, 0.8
# Bands of one MinHash each. A window that holds the least containment of a
# template has a Jaccard similarity of 0.19 or more with it and so collides in
# at least one of 64 bands with probability 1 - 0.81**64 = 0.999999.
BANDS = 64
# Usual license notices.
TEMPLATES = (
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "Released under the MIT License."),
    ("mit-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)


def license_words(raw: np.ndarray, at: np.ndarray) -> Words:
    """Runs of ASCII letters and digits (lowered) and bytes from 128; all else divides."""
    table = lower_ascii(np.arange(256, dtype=np.uint8))
    solid = ((table >= 97) & (table <= 122)) | ((table >= 48) & (table <= 57)) | (table >= 128)
    return words_of(np.where(solid, table, np.uint8(32))[raw], at)


class Templates:
    """Shingle sets, window sizes and MinHash values of license templates of k words or more.

    A template with s shingles belongs to the least power of two c >= s; it is
    looked for in windows of 2c shingles that begin at every quarter of c, so that
    any run of 7/4 c + 1 shingles lies in one window: a passage stays in one with
    three quarters of c words inserted, wherever it stands.
    """

    def __init__(self, templates: list[tuple[str, np.ndarray]], k: int, bands: int = BANDS):
        self.k, self.bands, self.names = k, bands, [name for name, _ in templates]
        self.sets = [np.unique(windows(words, k)) for _, words in templates]
        self.sizes = [1 << int(len(own) - 1).bit_length() for own in self.sets]
        self.known = np.unique(np.concatenate(self.sets))
        self.least = np.array([[mix(own, 1000 + b).min() for b in range(bands)] for own in self.sets], np.uint64)

    def hits(self, shingles: np.ndarray) -> np.ndarray:
        place = np.minimum(np.searchsorted(self.known, shingles), len(self.known) - 1)
        return np.flatnonzero(self.known[place] == shingles)

    def found(self, shingles: np.ndarray, share: float = CONTAINMENT) -> Iterator[tuple[int, int, float]]:
        """(template, first shingle of the window, containment) in one text, by window."""
        hits = self.hits(shingles)
        if not len(hits):
            return
        for size in sorted(set(self.sizes)):
            of_size = [t for t, s in enumerate(self.sizes) if s == size]
            step = max(1, size // 4)
            width, last = 2 * size // step, (len(shingles) - 1) // step
            # Only windows with a template's shingle can share a MinHash with it.
            begin = np.unique(np.unique(hits // step)[:, None] - np.arange(width))
            begin = begin[(begin >= 0) & (begin <= max(last - width + 1, 0))]
            parts = np.unique(np.minimum(begin[:, None] + np.arange(width), last))
            inside = np.minimum(parts[:, None] * step + np.arange(step), len(shingles) - 1)
            near, at = np.unique(inside, return_inverse=True)
            own = np.stack([mix(shingles[near], 1000 + b)[at.reshape(inside.shape)].min(axis=1) for b in range(self.bands)], axis=1)
            own = own[np.searchsorted(parts, np.minimum(begin[:, None] + np.arange(width), last))].min(axis=1)
            for t in of_size:
                for first in begin[(own == self.least[t]).any(axis=1)] * step:
                    held = float(np.isin(self.sets[t], shingles[first : first + 2 * size]).mean())
                    if held >= share:
                        yield t, int(first), held


def _by_shingle(templates: tuple[tuple[str, str], ...], k: int = SHINGLE) -> list[Templates]:
    """Templates by the words of their shingles: k, or all words of a shorter template."""
    groups: dict[int, list] = {}
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        hashes = license_words(raw, np.array([0, len(raw)])).hash
        if len(hashes):
            groups.setdefault(min(k, len(hashes)), []).append((name, hashes))
    return [Templates(own, words) for words, own in sorted(groups.items())]


def scan_licenses(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, share: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, containment, first_word, windows for every match.

    Words are runs of letters and digits, A-Z lowered. A template matches a text
    if a window has ``share`` or more of its 5-word shingles; containment is the
    greatest of any window and first_word the first window that has it, windows
    how many match (they overlap). Only windows that collide with the template in
    a MinHash band are compared. A template of fewer than 5 words is one shingle,
    its whole sequence; one without words matches nothing. Their number and length
    are up to the caller, who passes them as a parameter.

    Null and empty texts match nothing; repeated rows match each. A text is
    worked on alone whatever its length. Other columns are not read. An empty
    table, or no template, gives no rows.
    """
    known = _by_shingle(templates)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches if known else ():
            ids, rows = batch.column("doc_id"), []
            for low, _, raw, at in pieces(batch.column("text")):
                words = license_words(raw, at)
                bounds = bounds_of(words.owner, len(at) - 1)
                for group in known:
                    runs = windows(words.hash, group.k)
                    for i in np.unique(words.owner[group.hits(runs)] if len(runs) else ()).astype(np.int64):
                        best: dict[int, list] = {}
                        for t, begin, held in group.found(runs[bounds[i] : max(bounds[i], bounds[i + 1] - group.k + 1)], share):
                            old = best.setdefault(t, [held, begin, 0])
                            if held > old[0]:
                                old[:2] = held, begin
                            old[2] += 1
                        rows += [(low + i, group.names[t], *value) for t, value in sorted(best.items())]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(columns[0], pa.int64())), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.float64()), pa.array(columns[3], pa.int64()), pa.array(columns[4], pa.int64())],
                ["doc_id", "license", "containment", "first_word", "windows"],
            )

    rows = docs.select("doc_id", "text")
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(scan, f"doc_id {kind}, license string, containment double, first_word long, windows long")
