"""Word list, text patterns and operating settings.

They are part of the results' definition, so they are kept as they are.
"""

# The 90 search keywords, in order (order matters: the first 9 are
# charted and searched, the first 50 are tracked).
KEYWORDS = (
    "educacion, salud, pension, afp, piñera, gobierno, milicos, militares, pacos, "
    "carabineros, solidaridad, union, politicos, politica, congreso, diputado, "
    "diputada, diputados, senador, senadora, senadores, sueldos, enfermo, enfermedad, "
    "pobre, pobreza, cuico, cuica, cuicos, plata, lucas, dinero, social, sociedad, "
    "alcalde, asamblea, constitucion, pinochet, izquierda, derecha, renuncia, "
    "dictadura, colegio, colegios, universidad, universidades, presidente, presidenta, "
    "presidentes, fachos, facho, facha, comunista, comunistas, zurdos, zurda, zurdo, "
    "momio, momia, momios, represión, violencia, triste, pena, 1973, 73, tortura, "
    "muerte, bala, lacrimogena, baleos, arma, armas, cacerola, cacerolas, cacerolazo, "
    "balazos, saqueos, robos, quemar, incendiar, quemando, incinerar, transantiago, "
    "metro, micro, red, despertar, Chile, desperto"
).split(", ")

# Operating settings.
TRACKED = 50            # keywords with a series
CHARTED = 9             # keywords charted and searched
SNAPSHOT_POSTS = 100_000
POINTS_KEPT = 100       # newest minutes kept per series
TOP_WORDS = 35
REFRESH = "30 seconds"
HISTOGRAM_BINS = 10

# What counts as a handle or tag, a URL tail, punctuation, and the
# characters trimmed from token edges. [A-z] also covers [ \ ] ^ _ ` and stops at
# digits and accented letters.
HANDLE_OR_TAG = r"[@#][A-z]+"
URL_TAIL = r"[-a-zA-Z0-9:@;?&=/%+.*!'(),$_{}^~\[\]`#|]+"
PUNCTUATION = r"""[!¡"#$%&'()*+,\-./:;<=>?¿@\[\\\]^_`{|}~]"""
EDGE_CHARS = '",.:;?¿-()[]<>!¡“”|*/\\=+&$% '

# Every character that separates words when text is split on whitespace.
WHITESPACE = r"[\t-\r\x{1c}-\x{1f}\x{85}\p{Z}]+"

# Tokens never counted, besides the stop words.
NEVER_TOKENS = ("", "rt")

# Text formats of times.
POST_TIME_FORMAT = "MMM dd HH:mm:ss Z yyyy"     # after the weekday is cut off
NEWS_TIME_FORMAT = "dd/MM/yyyy HH:mm"
