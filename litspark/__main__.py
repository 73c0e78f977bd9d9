from litspark.cli import main

main()
