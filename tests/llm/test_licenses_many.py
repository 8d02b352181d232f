"""Many copies of a notice in one text."""

import time

from stratalog.llm import license_scan


def _text(copies):
    notice = dict(license_scan.TEMPLATES)["MIT-permission"]
    return license_scan.words_of(" ".join(f"{notice} " + " ".join(f"w{i}x{j}" for j in range(20)) for i in range(copies)).encode())


def _templates():
    own = sorted(((name, license_scan.words_of(text.encode())) for name, text in license_scan.TEMPLATES), key=lambda x: (-len(x[1]), x[0]))
    return [x for x in own if x[1]]


def test_each_copy_is_found_in_time_that_grows_with_their_number():
    own, took = len(license_scan.words_of(dict(license_scan.TEMPLATES)["MIT-permission"].encode())), []
    for copies in (100, 800):
        words = _text(copies)
        began = time.process_time()
        found = [(first, end) for name, _, first, end, _ in license_scan.scan_all(words, _templates(), 0.8) if name == "MIT-permission"]
        took.append(time.process_time() - began)
        assert found == [(i * (own + 20), i * (own + 20) + own) for i in range(copies)]
    assert took[1] < 16 * took[0]  # eight times the text; a square would be 64
