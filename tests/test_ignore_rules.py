import itertools
import os
import random
import shutil
import subprocess

import pytest

from lodestrata.sources import files as source

ALPHABET = ["a", "b", "*", "**", "?", "/", "/", "[ab]", "[!a]", "[^b-z]", "[[:alpha:]]", "[]a]", "[z-a]", "[a", "\\", "\\a", "!", "#", " ", ".", "-"]


@pytest.mark.skipif(not shutil.which("git"), reason="compares with git")
def test_rules_match_as_git_does(tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    names = ["a", "b", "ab", "ba", "]", "-", "a ", "#a", "!a", ".a"]
    paths = names + ["/".join(p) for p in itertools.product(["a", "b", "ab"], names)] + ["/".join(p) for p in itertools.product(["a", "ab"], ["a", "b"], names)]
    env = os.environ | {"GIT_CONFIG_GLOBAL": os.devnull, "GIT_CONFIG_SYSTEM": os.devnull, "XDG_CONFIG_HOME": str(tmp_path / "none")}
    rnd = random.Random(11)
    for _ in range(300):
        lines = ["".join(rnd.choices(ALPHABET, k=rnd.randint(1, 5))) + rnd.choice(["", "", "/", " ", "\\ "]) for _ in range(rnd.randint(1, 3))]
        (tmp_path / ".gitignore").write_text("\n".join(lines) + "\n")
        got = subprocess.run(["git", "check-ignore", "--no-index", "-z", "--stdin"], input="\0".join(paths) + "\0", cwd=tmp_path, env=env, capture_output=True, text=True)
        assert got.returncode in (0, 1), got.stderr
        theirs = set(got.stdout.split("\0")) - {""}
        own = [("", "", source.read_ignores(str(tmp_path)))]

        def below(path):
            parts = path.split("/")
            return any(source.ignored("/".join(parts[:k]), k < len(parts), own) for k in range(1, len(parts) + 1))

        assert {p for p in paths if below(p)} == theirs, lines
