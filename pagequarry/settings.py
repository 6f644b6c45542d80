"""Constants of the extraction jobs.

The values in this module are fixed values: results depend on them, so they are
stated once, plainly, and every operator takes them from here.
"""

# Elements whose text makes up the content of a page.
CONTENT_TAGS = ["p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "code", "pre"]

# Elements dropped, with everything in them, before anything else is read.
NOISE_TAGS = ["script", "style", "nav", "footer", "header", "aside", "form"]

# Elements tried in turn for the page title.
TITLE_TAGS = ["title", "h1", "h2"]

# Link targets starting with one of these are never followed.
SKIPPED_HREF_PREFIXES = ["#", "mailto:", "tel:", "javascript:"]

# Schemes a page can be fetched with.
WEB_SCHEMES = ["http", "https"]

# Fetching: seconds to wait for an answer, attempts per job, seconds before the first retry.
REQUEST_TIMEOUT = 30
MAX_ATTEMPTS = 3
RETRY_DELAY = 2

# Rendered fetches: milliseconds to wait.
RENDER_TIMEOUT_MS = 30000

# A static page with less markup than this (in characters) looks like a script shell.
MIN_HTML_LENGTH = 200

# Longest storage key, in characters.
MAX_KEY_LENGTH = 200

# Reports: characters of content and number of links shown.
PREVIEW_CHARS = 500
PREVIEW_LINKS = 5

# Status of a fetch that never got an answer.
NO_STATUS = -1

# Headers that every request is sent with (fixed values), besides its agent's name.
REQUEST_HEADERS = {
    "Accept": "text/html,application/xhtml+xml,application/xml;q=0.9,image/avif,image/webp,image/apng,*/*;q=0.8",
    "Accept-Language": "en-US,en;q=0.9",
    "Accept-Encoding": "gzip, deflate, br",
    "Connection": "keep-alive",
    "Upgrade-Insecure-Requests": "1",
    "Sec-Fetch-Dest": "document",
    "Sec-Fetch-Mode": "navigate",
    "Sec-Fetch-Site": "none",
    "Sec-Fetch-User": "?1",
    "Cache-Control": "max-age=0",
}

# Messages.
ERROR_NO_URL = "ScrapeRequest requires a non-empty URL."
ERROR_BAD_SCHEME = "Invalid URL '%s'. Must start with http:// or https://"
ERROR_BAD_TIMEOUT = "Timeout must be a positive integer, got %s."
ERROR_HTTP = "HTTP %s error: %s"
ERROR_TIMEOUT = "Request timed out after %ss"
ERROR_REDIRECTS = "Too many redirects — possible redirect loop"
ERROR_CONNECTION = "Connection failed — check network or URL"
ERROR_OTHER = "Unexpected error: %s"
ERROR_EXHAUSTED = "Failed after %s attempts: %s"
ERROR_RENDER_TIMEOUT = "Playwright timed out after %sms"
ERROR_RENDER_OTHER = "Playwright error: %s"
ERROR_NO_HTML = "No HTML content received from fetcher"
ERROR_PARSE = "Parsing failed: %s"

# Characters Python's str.strip() removes.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Characters Python's URL parser drops at the start of a URL (C0 controls and the blank).
C0_OR_SPACE = "".join(map(chr, range(0x21)))

# Characters a host may not hold: their compatibility form contains one of / ? # @ :
UNSAFE_HOST_CHARS = (
    "\u2047\u2048\u2049\u2100\u2101\u2105\u2106\u2a74\ufe13\ufe16"
    "\ufe55\ufe56\ufe5f\ufe6b\uff03\uff0f\uff1a\uff1f\uff20"
)
