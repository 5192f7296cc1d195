"""The SELECT dialect: tokens, syntax tree, types and binding."""
