"""The small graph of the tests."""

# People who mention, befriend and tweet; the answers are worked out by hand in the tests.
SOCIAL = [
    ("Sam", "friends", "Ann"), ("Sam", "friends", "Bob"), ("Ann", "friends", "Bob"), ("Bob", "friends", "Bob"),
    ("Sam", "mention", "Ann"), ("Ann", "mention", "Sam"), ("Bob", "mention", "Bob"), ("Sam", "mention", "Bob"),
    ("Sam", "lives", "Atlanta"), ("Ann", "lives", "Atlanta"), ("Bob", "lives", "Boston"),
    ("Ann", "tweet", '"t1"'), ("Ann", "tweet", '"t1"'), ("Bob", "tweet", '"t2"@en'), ("Bob", "likes", '"t1"'),
]
