"""Licences inside longer texts."""

from factloom.llm.license_scan import TEMPLATES, LicenseScanner

PROSE = " ".join(f"river{i} stone" for i in range(60))


def test_licences_inside_longer_texts():
    scanner = LicenseScanner()
    for name, which in (("MIT", 2), ("ISC", -1), ("BSD-2-Clause", -1), ("BSD-3-Clause", -1)):
        words = TEMPLATES[name][which].split()
        third = len(words) // 3
        parts = [words[:third], words[third : 2 * third], words[2 * third :]]
        wrapped = "\n\n".join("\n".join(" ".join(p[i : i + 9]) for i in range(0, len(p), 9)) for p in parts)
        assert scanner.scan(f"{PROSE}\n\n{wrapped}\n\n{PROSE}")[:3] == (name, 1.0, "window"), name
    assert scanner.scan(PROSE) == (None, 0.0, None, 0)
    assert scanner.scan(f"Prose here.\n{TEMPLATES['MIT'][0]}\n{PROSE}") == ("MIT", 1.0, "line", 1)
