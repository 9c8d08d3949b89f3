"""Import-time registration of every query section."""

from offerlake.plans import catalog

catalog._reports()
catalog._lookups()
catalog._audit()
catalog._feed()
catalog._pricing()
catalog._payments()
catalog._lifecycle()
catalog._joins()
catalog._sources()
catalog._streams()
