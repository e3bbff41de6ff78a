"""Fixed values of landed pages: which links lead to articles."""

#: Paths that speak for an article, and paths that speak against one.
ARTICLE = r"(?i)/(20\d{2}/|article|articles|news|story|stories|analysis|research|report|reports|publication|publications|commentary|insight|insights|press|blog|opinion|policy|event|events)/"
SKIP = r"(?i)/(tag|topic|author|authors|category|categories|about|contact|privacy|terms|login|subscribe|newsletter|podcast|video|videos)(/|$)"
