"""The whole suite collects in one run: no file hides another of its name."""
import os
import subprocess
import sys

HERE = os.path.dirname(os.path.abspath(__file__))


def test_every_test_file_is_collected():
    out = subprocess.run([sys.executable, "-m", "pytest", HERE, "--collect-only", "-q", "-p", "no:cacheprovider"], capture_output=True, text=True, timeout=300, cwd=os.path.dirname(HERE))
    assert out.returncode == 0, out.stdout[-2000:]
    files = [f for folder, _, names in os.walk(HERE) for f in names if f.startswith("test_") and f.endswith(".py")]
    assert all(f"{f}::" in out.stdout for f in files)
