import pytest
from pyspark.sql import functions as F

from rolefit.functions import contact, experience, names
from rolefit.functions.text import head_of_stripped
from rolefit.operators.profiles import parse_profiles
from rolefit.schemas import RESUMES

V = "v"


def test_experience(values):
    cases = [
        ("5 years of experience", 5, "Senior"),
        ("5+ years experience", 5, "Senior"),
        ("experience of 4 years", 4, "Senior"),
        ("3yrs experience", 3, "Junior"),
        ("5 years of professional experience", 0, "Fresher"),
        ("2.5 years experience", 5, "Senior"),
        ("1 year experience", 1, "Fresher"),
        ("refresher course; 9 years experience", 0, "Fresher"),
        ("7 yrs experience, 2 years of experience", 2, "Junior"),
        ("EXPERIENCE 10 YEARS", 10, "Senior"),
        ("no numbers", 0, "Fresher"),
        ("experience: many", 0, "Fresher"),
        ("٥ years experience", 5, "Senior"),
        ("99999999999999999999 years experience", 0, "Fresher"),
        ("experience 3 years then 4 years experience", 4, "Senior"),
        ("12\n years\n of\n experience", 12, "Senior"),
    ]
    years = experience.extract_experience_years(F.col(V))
    texts = [c[0] for c in cases]
    assert values(years, texts) == [c[1] for c in cases]
    assert values(experience.experience_level(years), texts) == [c[2] for c in cases]


def test_labelled_name(values):
    cases = [
        ("Name: john o'brien-smith", "John O'Brien-Smith"),
        ("\n\t Full  Name - ADA LOVELACE\nPython", "Ada Lovelace"),
        ("Username: foo bar", "Foo Bar"),
        ("Name: Madonna\nName: Jane Doe", None),
        ("Name: a b c d e", "A B C D"),
        ("Name:\nJane Doe", "Jane Doe"),
        ("name - J. R. Tolkien, author", "J. R. Tolkien"),
        (" " * 700 + "Name: Far Away", "Far Away"),
        ("x" * 600 + " Name: Too Late", None),
        ("", None),
        ("nothing here", None),
    ]
    assert values(names.extract_labelled_name(F.col(V)), [c[0] for c in cases]) == [
        c[1] for c in cases
    ]


def test_file_names(values):
    cases = {
        "jane_doe-cv.pdf": "Jane Doe Cv",
        "a.b.v2.PDF": "A.B.V2",
        "noext": "Noext",
        "__x.pdf": "  X",
        ".pdf": "",
    }
    assert values(names.name_from_filename(F.col(V)), list(cases)) == list(cases.values())


@pytest.mark.parametrize("text", ["o'brien-smith", "R&D lead", "élan VITAL", "a1b2 c", "ΑΒγ δ", "straße ßa", "ΟΔΟΣ ΣΟΦΟΣ", "İZMİR yolu", ""])
def test_title_case_is_the_python_one(values, text):
    assert values(names.title_case(F.col(V)), [text]) == [text.title()]


def test_email_and_phone(values):
    cases = [
        ("mail a.b+c@x-y.co.uk now", "a.b+c@x-y.co.uk", ""),
        ("first@x first2@y.io", "first2@y.io", ""),
        ("x@y.c", "", ""),
        ("a@b.com.", "a@b.com", ""),
        ("a@b@c.com", "b@c.com", ""),
        ("@@x@y.com", "x@y.com", ""),
        ("+91 8830000000", "", "+91 88300000"),
        ("call 2019-202312 or 9876543210", "", "2019-202312"),
        ("1234567890123456", "", "1234567890123"),
        ("555-1234", "", ""),
        ("(020) 12345678", "", "12345678"),
        ("12 3456789", "", "12 3456789"),
        ("", "", ""),
    ]
    texts = [c[0] for c in cases]
    assert values(contact.extract_email(F.col(V)), texts) == [c[1] for c in cases]
    assert values(contact.extract_phone(F.col(V)), texts) == [c[2] for c in cases]


def test_long_runs_stay_cheap(values):
    texts = ["a" * 300_000 + " end", "1" * 300_000 + " years"]
    assert values(contact.extract_email(F.concat(F.col(V), F.lit(" @ x"))), texts) == ["", ""]
    assert values(
        experience.extract_experience_years(F.concat(F.col(V), F.lit(" experience"))), texts
    ) == [0, 0]


def test_head_of_stripped(values):
    assert values(head_of_stripped(F.col(V), 3), ["  \x1c\nabcd", "ab", "", "a\nb\nc"]) == [
        "abc", "ab", "", "a\nb",
    ]


def test_format_experience(values):
    shown = experience.format_experience(F.lit("Senior"), F.col(V))
    assert values(shown, [5, 0], "bigint") == ["Senior (5 Yrs)", "Senior"]


def test_parse_profiles(spark):
    rows = [
        (1, 7, "jane_doe.pdf", "Name: Jane Roe\njane@roe.org +4912345678 4 years experience", None),
        (2, 7, "no-text.pdf", "", None),
        (3, 7, "plain.PDF", "nothing to see", None),
        (4, 7, "null.pdf", None, None),
    ]
    frame = spark.createDataFrame(rows, RESUMES)
    got = [
        (r.candidate_id, r.name, r.email, r.phone, r.experience_years, r.experience_level, r.resume_path)
        for r in parse_profiles(frame).orderBy("candidate_id").collect()
    ]
    assert got == [
        (1, "Jane Roe", "jane@roe.org", "+4912345678", 4, "Senior", "resumes/jane_doe.pdf"),
        (2, "No Text", "", "", 0, "Fresher", "resumes/no-text.pdf"),
        (3, "Plain", "noemail_3@ats.local", "", 0, "Fresher", "resumes/plain.PDF"),
        (4, "Null", "", "", 0, "Fresher", "resumes/null.pdf"),
    ]
