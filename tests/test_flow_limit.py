"""Every flow is narrated unless the settings or the caller set a limit."""

from symbolake import cli
from symbolake.providers import Offline
from symbolake.session import Session


def test_all_flows(spark, tmp_path, monkeypatch):
    (tmp_path / "many").mkdir()
    (tmp_path / "many/calls.py").write_text("def leaf():\n    return 1\n" + "".join(f"\n\ndef start_{i}():\n    return leaf()\n" for i in range(25)))
    s = Session(spark, f"file://{tmp_path}/index", provider=Offline)
    s.link([f"{tmp_path}/many"], embed=False, flows=True)
    assert s.store.read("flows").count() == 25


def test_settings_reach_the_session(spark, tmp_path, monkeypatch):
    seen = {}
    monkeypatch.setattr(Session, "link", lambda self, roots, **steps: seen.update(steps) or {})
    (tmp_path / "c.toml").write_text("max_flows = 3\n")
    monkeypatch.setenv("SYMBOLAKE_MAX_ENRICH", "7")
    assert cli.main(["--config", f"{tmp_path}/c.toml", "link", str(tmp_path), "--index-dir", f"{tmp_path}/index"], spark) == 0
    assert seen["max_flows"] == 3 and seen["max_enrich"] == 7
