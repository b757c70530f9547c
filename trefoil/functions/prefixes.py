"""Namespace lists of the public benchmark data sets.

Fixed values: short names and namespaces must equal those used when the data
was published, otherwise stored terms and query terms do not meet.
"""

WATDIV = [
    ("dc", "http://purl.org/dc/terms/"),
    ("foaf", "http://xmlns.com/foaf/"),
    ("gr", "http://purl.org/goodrelations/"),
    ("gn", "http://www.geonames.org/ontology#"),
    ("mo", "http://purl.org/ontology/mo/"),
    ("og", "http://ogp.me/ns#"),
    ("rev", "http://purl.org/stuff/rev#"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("sorg", "http://schema.org/"),
    ("wsdbm", "http://db.uwaterloo.ca/~galuc/wsdbm/"),
]

LUBM = [
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("ub", "http://www.lehigh.edu/~zhp2/2004/0401/univ-bench.owl#"),
    ("swt", "http://swat.cse.lehigh.edu/onto/univ-bench.owl#"),
    ("w3c", "http://www.w3.org/2002/07/owl#"),
]

YAGO = [
    ("yago", "http://yago-knowledge.org/resource/"),
    ("dbp", "http://dbpedia.org/ontology/"),
    ("owl", "http://www.w3.org/2002/07/owl#"),
    ("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"),
    ("rdfs", "http://www.w3.org/2000/01/rdf-schema#"),
    ("skos", "http://www.w3.org/2004/02/skos/core#"),
    ("xsd", "http://www.w3.org/2001/XMLSchema#"),
    ("yagoc", "http://dbpedia.org/class/yago/"),
    ("dbr", "http://dbpedia.org/resource/"),
]

GENERIC: list[tuple[str, str]] = []


def read_prefixes(spark, path):
    """A prefix file of ``short<TAB>namespace`` rows as a prefix list.

    A prefix file is a hand-written schema file of a few dozen rows, so it is
    read to the driver and becomes part of the column expressions.
    """
    rows = spark.read.schema("short string, namespace string").csv(path, sep="\t", quote="")
    return [(r["short"], r["namespace"]) for r in rows.dropna().collect()]
