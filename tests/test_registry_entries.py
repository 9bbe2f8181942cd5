from docweave.operators.entities import Registry


def test_an_entry_renamed_to_the_name_of_another_keeps_both():
    """The first entry takes the form over by "Ann", and in the end the name of the second."""
    names = Registry()
    got = [names.resolve(i, f, "x") for i, f in enumerate(["Annabel", "Annette", "Ann", "Annette", "Annette"])]
    assert got == ["Annabel", "Annette", "Annabel", "Annabel", "Annette"]
    rows = [(r[1], r[3]) for r in names.rows()]
    assert rows == [("Annette", {"Annette": 1}), ("Annette", {"Annabel": 1, "Ann": 1, "Annette": 2})]
    assert [(r[1], r[3]) for r in Registry.restored(names.rows()).rows()] == rows and len(names) == 2
