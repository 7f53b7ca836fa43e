from quillgraph.sources import vault


def test_listing(spark, tmp_path):
    for name, text in (("a.md", "# A\r\nx"), ("sub/b.MD", "\n"), ("Archive/old.md", "x"), ("c.py", "x"), ("d.json", "{}")):
        p = tmp_path / "v" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(text.encode())
    listed = vault.listing(spark, vault.VaultConfig(f"file://{tmp_path}/v", patterns=("*.md", "*.MD", "*.json")))
    files = {r["path"]: r for r in vault.inventory(listed).collect()}
    assert set(files) == {"a.md", "sub/b.MD", "d.json"}
    assert files["sub/b.MD"]["is_empty_note"] and not files["a.md"]["is_empty_note"] and not files["d.json"]["is_markdown"]
    assert {r["path"]: r["text"] for r in vault.notes(listed).collect()} == {"a.md": "# A\nx", "sub/b.MD": "\n"}
