"""Every licence is recognised as itself and as no other; windows against every window."""

import random

from factloom.llm.license_scan import LicenseScanner, all_templates, bigrams, normalised

SCANNER = LicenseScanner()


def names_in(text):
    """Every licence that a unit or a window of a text is named by."""
    units = [(w, got) for _, w in SCANNER.units(text) if (got := SCANNER.best(w))]
    return {got[2] for _, got in units} | {name for _, name in SCANNER.windows(text, [w for w, _ in units])}


def test_all_templates_name_themselves_alone():
    every = all_templates()
    assert len(every) >= 40
    for name, texts in every.items():
        for text in texts:
            assert SCANNER.scan(text)[:2] == (name, 1.0), (name, text)
            assert names_in(text) == {name}, (name, text)
            middle = names_in(f"river stone moss\n\n{text}\n\nfern lake {text.split()[0]}")
            assert middle == {name}, (name, middle)


def test_versions_are_told_apart():
    notice = all_templates()["GPL-3.0"][1]
    assert SCANNER.scan(notice.replace("version 3", "version 2"))[0] == "GPL-2.0"
    assert SCANNER.scan(notice.replace("version 3", "version 7"))[0] is None
    assert SCANNER.scan(notice.replace("GNU General", "GNU Lesser General"))[0] == "LGPL-3.0"
    assert SCANNER.scan("/*\n * SPDX-License-Identifier: MIT\n */\nint main")[0] == "MIT"
    assert SCANNER.scan("SPDX-License-Identifier: Nothing-9.9")[0] is None


def test_windows_are_the_best_of_all():
    """The best window of a text, by trying each, is among those that are found."""
    rng = random.Random(5)
    every = [(name, t) for name, ts in all_templates().items() for t in ts if 8 <= len(normalised(t)) <= 60]
    for _ in range(40):
        name, text = rng.choice(every)
        words = normalised(text)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(len(words))] = f"odd{rng.randrange(9)}"
        words = [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))] + words + [f"w{rng.randrange(40)}" for _ in range(rng.randrange(30))]
        best = 0.0
        for a in range(len(words)):
            for z in range(a + 2, len(words) + 1):
                own = bigrams(words[a:z])
                for t, i, _, b in SCANNER.made:
                    d = 2 * len(own & b) / (len(own) + t)
                    if d >= SCANNER.threshold and d > best and SCANNER.decided(i, own):
                        best = d
        found = [d for d, _ in SCANNER.windows(" ".join(words), [])]
        assert max(found, default=0.0) == best, (name, words)
