"""A lending library: rows made by rule, with nulls and dangling keys, and plain loops to check against."""

from marlstone import connect

TEXT = """
@db(index="land")
entity type Author { id: int, name: string, land: string, books: [Book](authorId, id) }
@db(unique="isbn", index="genre")
entity type Book schema name "STOCK" {
  isbn: string schema name "ISBN_13"
  id: int
  authorId: int schema name "WRITER"
  genre: string = "unsorted"
  price: double
  pages: int = 1
  author: Author(authorId)
  loans: [Loan](bookId, id)
}
entity type Member { id: int, city: string, loans: [Loan](memberId, id), visits: timeseries<double>(id) }
entity type Loan { id: long, bookId: int, memberId: int, days: int, late: boolean, book: Book(bookId), member: Member(memberId) }
"""
AUTHORS = [{"id": k, "name": n, "land": c} for k, n, c in ((1, "Ito", "jp"), (2, "Obi", "ng"), (3, "Lund", "se"), (4, "Kaya", None))]
BOOKS = [
    {"id": 10 + k, "isbn": f"978-{k * 7 % 13:03}", "authorId": (1, 2, 3, 1, None, 4, 77)[k % 7], "genre": ("novel", "verse", "essay")[k % 3], "price": None if k % 5 == 4 else 4.25 + 1.5 * (k * 5 % 7), "pages": 60 + 41 * k % 160}
    for k in range(13)
]
MEMBERS = [{"id": k, "city": ("Oslo", "Accra", None)[k % 3]} for k in range(100, 105)]
LOANS = [{"id": 5000 + k, "bookId": 10 + k * k % 15, "memberId": 100 + k % 6, "days": 3 + k * 4 % 25, "late": (True, False, None)[k % 3]} for k in range(21)]
#: Points of two members; 30 to a segment.
VISITS = {100: [(40 + 6 * k, k * 0.5 - 7) for k in range(110)], 103: [(41, 2.0), (41, 3.0)]}
ROWS = {"Author": AUTHORS, "Book": BOOKS, "Member": MEMBERS, "Loan": LOANS}


def filled(spark, path, **more):
    ses = connect(spark, TEXT, f"file://{path}", **more)
    for name, rows in ROWS.items():
        ses[name].create(rows)
    return ses


def of(rows, **keys):
    """Those that have these values."""
    return [r for r in rows if all(r[k] == v for k, v in keys.items())]


def author(book):
    return next(iter(of(AUTHORS, id=book["authorId"])), None)


def land(book):
    return (author(book) or {}).get("land")


def ids(rows):
    return [r["id"] for r in rows]
