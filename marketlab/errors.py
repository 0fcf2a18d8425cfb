"""What can go wrong, as classes: one base that a caller may catch."""


class MarketError(ValueError):
    """Base of all errors that a caller can put right or must know of."""


class ZoneError(MarketError):
    """A display zone that is no IANA name."""


class UnknownName(MarketError):
    """No instrument answers to a query."""


class VendorError(MarketError):
    """A vendor's answer cannot be used."""


class Quota(VendorError):
    """The vendor wants fewer calls; later ones may succeed."""


class Permanent(VendorError):
    """The vendor will not answer this call at any time."""


class Incomplete(VendorError):
    """The vendor gave part of a span; the span must not count as covered."""


class NoTimeframe(MarketError):
    """The vendor has no bars of this timeframe."""


class BadBar(MarketError):
    """A bar without valid prices."""


class UnknownStrategy(MarketError):
    """No strategy of that name is registered."""


class BadSpec(MarketError):
    """A specification that cannot be run."""


class NotCovered(MarketError):
    """Bars or quotes that a panel needs are not in the store."""
