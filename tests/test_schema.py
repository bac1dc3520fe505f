from forumlake.schema import ENUMS, FOREIGN_KEYS, TABLES, UNIQUE_KEYS, primary_key, struct_type


def test_inventory():
    assert len(TABLES) == 27 and len(ENUMS) == 11
    assert len(FOREIGN_KEYS) == 39
    assert sum(fk.on_delete == "cascade" for fk in FOREIGN_KEYS) == 36
    assert len(UNIQUE_KEYS) == 14


def test_keys_exist():
    for name, columns in TABLES.items():
        names = {c.name for c in columns}
        assert primary_key(name) in names
        assert set(UNIQUE_KEYS.get(name, ())) <= names
        assert [f.name for f in struct_type(name)] == [c.name for c in columns]
    assert all(fk.parent in TABLES for fk in FOREIGN_KEYS)
