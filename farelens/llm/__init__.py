"""Training-data operators: each module holds one operator, ``queries`` the
registered ``opN_<name>`` queries. Nothing outside this package imports it."""
